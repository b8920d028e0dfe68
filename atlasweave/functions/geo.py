"""Distances, cells and planar geometry."""

from __future__ import annotations

import json
import math
import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave import schema as S

RADIUS_METERS = 6_378_100.0


def distance_meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the spherical law of cosines, whole meters."""
    a, b = F.radians(lat1), F.radians(lat2)
    c = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lng2) - F.radians(lng1))
    return F.floor(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c))) * RADIUS_METERS).cast("bigint")


def miles(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Haversine distance in miles on a sphere of 3956 miles."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(3956.0 * 2) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def in_bounds(lat: Column, lng: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Whether a point lies in a box that may cross the antimeridian."""
    return lat.between(south, north) & F.when(west <= east, lng.between(west, east)).otherwise((lng >= west) | (lng <= east))


def middle(box: Column) -> Column:
    """The centre of a box (south, west, north, east) that may cross the antimeridian, as a struct of lat and lng."""
    east = F.when(box["east"] < box["west"], box["east"] + 360).otherwise(box["east"])
    lng = (box["west"] + east) / 2
    return F.struct(((box["south"] + box["north"]) / 2).alias("lat"), F.when(lng > 180, lng - 360).otherwise(lng).alias("lng"))


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two boxes that may cross the antimeridian share a point."""
    at = lambda box, x: F.when(box["west"] <= box["east"], x.between(box["west"], box["east"])).otherwise((x >= box["west"]) | (x <= box["east"]))
    return (a["south"] <= b["north"]) & (b["south"] <= a["north"]) & (at(a, b["west"]) | at(b, a["west"]))


def box_wkt(box: Column) -> Column:
    """A box as the text of a polygon."""
    corner = lambda x, y: F.concat(box[x].cast("string"), F.lit(" "), box[y].cast("string"))
    ring = [corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south")]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *ring), F.lit("))"))


def bucket(x: Column, size: float = 0.15) -> Column:
    """The quantised coordinate, truncated toward zero."""
    q = x / size
    return F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint")


def level_of(woe: Column) -> Column:
    """The level at which places of a type are matched by cell."""
    return F.when(woe == S.COUNTRY, 4).when(woe.isin(S.ADMIN1, S.ADMIN2), 6).when(woe.isin(S.ADMIN3, S.TOWN), 8).otherwise(10)


def woe_order(woe: Column) -> Column:
    """Position from specific to general, -1 if unlisted."""
    return F.array_position(F.array(*map(F.lit, S.SPECIFIC_TO_GENERAL)), woe).cast("int") - 1


def cell_parent(cell: Column, level: int) -> Column:
    """The ancestor of a cell id at a level, by its bits."""
    low = 1 << (2 * (30 - level))
    return cell.bitwiseAND(F.lit(-low)).bitwiseOR(F.lit(low))


# cells on the faces of a cube, ordered along a Hilbert curve


def cell_ids(lat: np.ndarray, lng: np.ndarray, level: int = 30) -> np.ndarray:
    """64-bit cell ids (signed) of points at a level: face, 60 bits of curve position, a trailing one."""
    phi, theta = np.radians(np.asarray(lat, float)), np.radians(np.asarray(lng, float))
    x, y, z = np.cos(phi) * np.cos(theta), np.cos(phi) * np.sin(theta), np.sin(phi)
    axis = np.argmax(np.abs([x, y, z]), axis=0)
    front = np.choose(axis, [x, y, z])
    face = axis + 3 * (front < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        u = np.choose(face, [y / x, -x / y, -x / z, z / x, z / y, -y / z])
        v = np.choose(face, [z / x, z / y, -y / z, y / x, -x / y, -x / z])
    size = 1 << 30
    ij = []
    for w in (u, v):
        st = np.where(w >= 0, 0.5 * np.sqrt(1 + 3 * np.abs(w)), 1 - 0.5 * np.sqrt(1 + 3 * np.abs(w)))
        ij.append(np.clip(np.floor(st * size), 0, size - 1).astype(np.int64))
    return _from_ij(face.astype(np.int64), ij[0], ij[1], level)


_ORDER = np.array([[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]])  # orientation, cell (i * 2 + j) to position
_TURN = np.array([1, 0, 0, 3])  # position to change of orientation: 1 swaps, 2 inverts


def _from_ij(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
    pos = np.zeros(face.shape, np.uint64)
    turn = face & 1
    for k in range(29, 29 - level, -1):
        cell = ((i >> k) & 1) * 2 + ((j >> k) & 1)
        p = _ORDER[turn, cell]
        pos = pos << np.uint64(2) | p.astype(np.uint64)
        turn = turn ^ _TURN[p]
    out = face.astype(np.uint64) << np.uint64(61) | pos << np.uint64(61 - 2 * level) | np.uint64(1 << (60 - 2 * level))
    return out.view(np.int64)


def cell_udf(level: int):
    @F.pandas_udf(T.LongType())
    def cell(lat: pd.Series, lng: pd.Series) -> pd.Series:
        return pd.Series(cell_ids(lat.to_numpy(), lng.to_numpy(), level))

    return cell


def cell_level(cell: int) -> int:
    return 30 - ((cell & -cell).bit_length() - 1) // 2


def levels_of(cells: np.ndarray) -> np.ndarray:
    """Levels of many cells, by their lowest bit."""
    return 30 - np.log2((cells & -cells).view(np.uint64).astype(float)).astype(np.int64) // 2


def parents_at(cells: np.ndarray, level: int) -> np.ndarray:
    """The ancestors of cells at a level."""
    low = np.int64(1 << (2 * (30 - level)))
    return (cells & -low) | low


def box_ring(south: float, west: float, north: float, east: float) -> np.ndarray:
    """The corners of a box; one that crosses the antimeridian goes on beyond 180 degrees."""
    east = east + 360 if east < west else east
    return np.array([[west, south], [east, south], [east, north], [west, north]])


# well-known binary, and planar predicates over rings of (lng, lat)


def read_wkb(b: bytes) -> list[list[np.ndarray]]:
    """Polygons as lists of rings (outer first) of a WKB polygon or multipolygon; a point is one ring of one vertex.

    Anything that can't be read is a ValueError."""
    pos = 0

    def geometry():
        nonlocal pos
        e = "<" if b[pos] else ">"
        kind = struct.unpack_from(e + "I", b, pos + 1)[0] & 0xFF
        pos += 5

        def count():
            nonlocal pos
            n = struct.unpack_from(e + "I", b, pos)[0]
            pos += 4
            return n

        def points(n):
            nonlocal pos
            out = np.frombuffer(b, e + "f8", 2 * n, pos).reshape(n, 2).astype(float)
            pos += 16 * n
            return out

        if kind == 1:
            return [[points(1)]]
        if kind == 2:
            return [[points(count())]]
        if kind == 3:
            return [[points(count()) for _ in range(count())]]
        if kind in (4, 5, 6, 7):
            return [p for _ in range(count()) for p in geometry()]
        raise ValueError(f"geometry of kind {kind}")

    try:
        return geometry()
    except struct.error as e:
        raise ValueError("cut off") from e


def shape_of(wkb: bytes | None) -> list[list[np.ndarray]]:
    """The polygons of a binary; none if it can't be read."""
    try:
        return read_wkb(bytes(wkb))
    except (ValueError, TypeError, IndexError):
        return []


def read_text(text: str | None) -> list[list[np.ndarray]]:
    """The polygons of well-known text or a GeoJSON geometry; none if it can't be read."""
    try:
        if text.lstrip().startswith("{"):
            g = json.loads(text)
            kind, at = g["type"].upper(), g["coordinates"]
        else:
            kind, rest = re.fullmatch(r"\s*([A-Za-z]+)\s*(?:Z|M)?\s*(\(.*\))\s*", text, re.S).groups()
            kind = kind.upper()
            rest = re.sub(r"[-+0-9.eE]+(?:\s+[-+0-9.eE]+)+", lambda m: "[" + ",".join(m[0].split()) + "]", rest)
            at = json.loads(rest.replace("(", "[").replace(")", "]"))
            at = at[0] if kind == "POINT" else at
        ring = lambda r: np.array([p[:2] for p in r], float).reshape(-1, 2)
        if kind == "POINT":
            return [[ring([at])]]
        if kind == "LINESTRING":
            return [[ring(at)]]
        if kind == "POLYGON":
            return [[ring(r) for r in at]]
        if kind == "MULTIPOLYGON":
            return [[ring(r) for r in p] for p in at]
    except (ValueError, TypeError, KeyError, IndexError, AttributeError):
        pass
    return []


def write_text(polygons: list[list[np.ndarray]]) -> str:
    """Well-known text of a polygon, or of a multipolygon if there are several."""
    one = lambda rings: "(" + ", ".join("(" + ", ".join(f"{x:.12g} {y:.12g}" for x, y in r) + ")" for r in rings) + ")"
    return f"POLYGON {one(polygons[0])}" if len(polygons) == 1 else "MULTIPOLYGON (" + ", ".join(map(one, polygons)) + ")"


@F.pandas_udf(T.BinaryType())
def wkb_of_text(text: pd.Series) -> pd.Series:
    """Well-known binary of well-known text or GeoJSON; null if it can't be read."""
    return text.map(lambda t: write_wkb(p) if (p := read_text(t)) else None)


def write_wkb(polygons: list[list[np.ndarray]]) -> bytes:
    """Little-endian WKB of a polygon, or of a multipolygon if there are several."""
    one = lambda rings: struct.pack("<BII", 1, 3, len(rings)) + b"".join(struct.pack("<I", len(r)) + np.asarray(r, "<f8").tobytes() for r in rings)
    return one(polygons[0]) if len(polygons) == 1 else struct.pack("<BII", 1, 6, len(polygons)) + b"".join(map(one, polygons))


def _in_ring(ring: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ray casting of all points against all edges, in blocks of about a million pairs."""
    shape = np.shape(x)
    x, y = np.ravel(x), np.ravel(y)
    a, b = ring[:, 0, None], ring[:, 1, None]
    c, d = np.roll(a, -1, axis=0), np.roll(b, -1, axis=0)
    rise = np.where(d == b, 1.0, d - b)
    inside = np.zeros(len(x), bool)
    step = max(1, 1_000_000 // max(1, len(ring)))
    for lo in range(0, len(x), step):
        px, py = x[None, lo : lo + step], y[None, lo : lo + step]
        inside[lo : lo + step] = (((b > py) != (d > py)) & (px < (c - a) * (py - b) / rise + a)).sum(axis=0) & 1
    return inside.reshape(shape)


def contains(polygons: list[list[np.ndarray]], x, y) -> np.ndarray:
    """Whether points lie inside, by ray casting; holes count."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    out = np.zeros(x.shape, bool)
    for rings in polygons:
        own = _in_ring(rings[0], x, y)
        for hole in rings[1:]:
            own &= ~_in_ring(hole, x, y)
        out |= own
    return out


def clip(ring: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """The part of a ring inside a convex ring, by cutting at each side in turn; neither repeats its first vertex."""
    turn = 1.0 if _signed_area(convex) >= 0 else -1.0
    for a, b in zip(convex, np.roll(convex, -1, axis=0)):
        if not len(ring):
            break
        side = turn * ((b[0] - a[0]) * (ring[:, 1] - a[1]) - (b[1] - a[1]) * (ring[:, 0] - a[0]))
        inside = side >= 0
        if inside.all():
            continue
        to, after = np.roll(ring, -1, axis=0), np.roll(side, -1)
        crosses = inside != np.roll(inside, -1)
        with np.errstate(divide="ignore", invalid="ignore"):
            cut = ring + (side / (side - after))[:, None] * (to - ring)
        both = np.stack([ring, cut], axis=1).reshape(-1, 2)
        ring = both[np.stack([inside, crosses], axis=1).ravel()]
    return ring


def clip_box(ring: np.ndarray, west: float, south: float, east: float, north: float) -> np.ndarray:
    """The part of a ring inside a box."""
    return clip(ring, np.array([[west, south], [east, south], [east, north], [west, north]]))


def opened(ring: np.ndarray) -> np.ndarray:
    """A ring without the repetition of its first vertex."""
    return ring[:-1] if len(ring) > 1 and (ring[0] == ring[-1]).all() else ring


def overlap(polygons: list[list[np.ndarray]], convex: np.ndarray) -> tuple[float, float]:
    """(area that polygons share with a convex ring, area of the polygons), holes taken out, in square degrees."""
    low, high = convex.min(axis=0), convex.max(axis=0)
    both = total = 0.0
    for rings in polygons:
        for k, ring in enumerate(rings):
            r, sign = opened(ring), -1 if k else 1
            total += sign * area(r)
            to = np.roll(r, -1, axis=0)
            near = ((np.minimum(r, to) <= high) & (np.maximum(r, to) >= low)).all(axis=1)
            if near.any():
                both += sign * area(clip(r, convex))
            elif contains([[r]], [(low[0] + high[0]) / 2], [(low[1] + high[1]) / 2])[0]:
                both += sign * area(convex)
    return both, total


def _signed_area(ring: np.ndarray) -> float:
    x, y = ring[:, 0] - ring[0, 0], ring[:, 1] - ring[0, 1]  # near to 0, so that small rings keep their digits
    return float(np.dot(x, np.roll(y, -1)) - np.dot(y, np.roll(x, -1))) / 2


def area(ring: np.ndarray) -> float:
    """Unsigned area by the shoelace formula."""
    return abs(_signed_area(ring)) if len(ring) > 2 else 0.0


def simplify(ring: np.ndarray, tolerance: float = 0.0001) -> np.ndarray:
    """Vertices that lie farther than the tolerance from the line between their kept neighbours."""
    keep, todo = {0, len(ring) - 1}, [(0, len(ring) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        a, d = ring[lo], ring[hi] - ring[lo]
        p = ring[lo + 1 : hi] - a
        n = float(np.hypot(*d))
        far = np.abs(p[:, 0] * d[1] - p[:, 1] * d[0]) / n if n else np.hypot(p[:, 0], p[:, 1])
        k = int(np.argmax(far))
        if far[k] > tolerance:
            keep.add(lo + 1 + k)
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return ring[sorted(keep)]


def circle(lat: float, lng: float, meters: float) -> np.ndarray:
    """A closed ring around a point on the sphere; the radius is capped at 5,000 m, sides grow with it."""
    return circles(np.array([lat], float), np.array([lng], float), meters)[0]


def circles(lat: np.ndarray, lng: np.ndarray, meters: float) -> np.ndarray:
    """The rings of ``circle`` around many points: points x vertices x 2."""
    meters = min(meters, 5000.0)
    sides = min(100, 32 + 16 * (math.ceil(meters / 40) // 5))
    d, p, q = meters / RADIUS_METERS, np.radians(lat)[:, None], np.radians(lng)[:, None]
    t = np.linspace(0, 2 * np.pi, sides, endpoint=False)
    a = np.arcsin(np.sin(p) * np.cos(d) + np.cos(p) * np.sin(d) * np.cos(t))
    b = q + np.arctan2(np.sin(t) * np.sin(d) * np.cos(p), np.cos(d) - np.sin(p) * np.sin(a))
    out = np.degrees(np.stack([b, a], axis=2))
    return np.concatenate([out, out[:, :1]], axis=1)


def circles_wkb(lat: np.ndarray, lng: np.ndarray, meters: float) -> list[bytes]:
    """The circles around many points as WKB."""
    rings = circles(lat, lng, meters).astype("<f8")
    head = struct.pack("<BIII", 1, 3, 1, rings.shape[1])
    return [head + r.tobytes() for r in rings]
