"""A data source for shapefiles: ``spark.dataSource.register(Shapefile)``, then ``format("shapefile")``.

Rows are (attributes map<string,string>, wkb binary). The file is cut into byte ranges of whole records by its index file,
so that parts are read by different tasks.
"""

from __future__ import annotations

import os
import struct

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from atlasweave.functions.geo import write_wkb

RECORDS = 2000  # in one partition


class _Part(InputPartition):
    def __init__(self, lo: int, hi: int):
        super().__init__(lo)
        self.lo, self.hi = lo, hi


def _signed(ring: np.ndarray) -> float:
    return float(np.dot(ring[:, 0], np.roll(ring[:, 1], -1)) - np.dot(ring[:, 1], np.roll(ring[:, 0], -1)))


def shape_wkb(b: bytes) -> bytes | None:
    """A point or polygon record as WKB; clockwise rings begin a polygon, others are its holes."""
    kind = struct.unpack_from("<i", b)[0]
    if kind in (1, 11, 21):
        return struct.pack("<BI", 1, 1) + b[4:20]
    if kind not in (5, 15, 25):
        return None
    parts, points = struct.unpack_from("<ii", b, 36)
    starts = [*struct.unpack_from(f"<{parts}i", b, 44), points]
    xy = np.frombuffer(b, "<f8", 2 * points, 44 + 4 * parts).reshape(points, 2)
    polygons: list[list[np.ndarray]] = []
    for s, e in zip(starts, starts[1:]):
        ring = xy[s:e]
        if not polygons or _signed(ring) < 0:
            polygons.append([ring])
        else:
            polygons[-1].append(ring)
    return write_wkb(polygons) if polygons else None


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.base = os.path.splitext(path)[0]

    def partitions(self):
        n = (os.path.getsize(self.base + ".shx") - 100) // 8
        return [_Part(i, min(n, i + RECORDS)) for i in range(0, max(n, 1), RECORDS)]

    def read(self, part):
        with open(self.base + ".dbf", "rb") as dbf, open(self.base + ".shx", "rb") as shx, open(self.base + ".shp", "rb") as shp:
            head = dbf.read(32)
            start, width = struct.unpack_from("<HH", head, 8)
            fields, at = [], 1
            for _ in range((start - 33) // 32):
                f = dbf.read(32)
                fields.append((f[:11].split(b"\0")[0].decode(), at, f[16]))
                at += f[16]
            for i in range(part.lo, part.hi):
                shx.seek(100 + 8 * i)
                offset, size = struct.unpack(">ii", shx.read(8))
                shp.seek(offset * 2 + 8)
                wkb = shape_wkb(shp.read(size * 2))
                dbf.seek(start + width * i)
                row = dbf.read(width)
                yield {n: row[a : a + w].decode("utf-8", "replace").strip() for n, a, w in fields}, wkb


class Shapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapefile"

    def schema(self) -> str:
        return "attributes map<string,string>, wkb binary"

    def reader(self, schema):
        return _Reader(self.options["path"])
