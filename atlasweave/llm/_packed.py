"""Sorted 64-bit keys and counts as compressed blocks, for shuffles that would else move a row for each key."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

HELD = 4_000_000  # keys a task holds before it sends blocks


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as differences and counts, byte plane by byte plane, compressed."""
    d = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    c = counts.astype("<u4")
    raw = d.view(np.uint8).reshape(-1, 8).T.tobytes() + c.view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(keys).to_bytes(8, "little") + bytes(pa.Codec("zstd").compress(raw, asbytes=True))


def unpack(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(block[:8], "little")
    raw = np.frombuffer(pa.Codec("zstd").decompress(block[8:], decompressed_size=12 * n, asbytes=True), np.uint8)
    keys = np.cumsum(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)
    return keys, np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<u4").ravel()


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def blocks(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, kind: int = 0) -> Iterator[tuple[int, int, bytes]]:
    for s in np.unique(shard):
        m = shard == s
        yield int(s), kind, pack(keys[m], counts[m])


def block_rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    s, k, p = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.int32()), pa.array(p, pa.binary())], ["shard", "kind", "block"])


BLOCK = "shard int, kind int, block binary"


def save(folder: str, name: str, a: np.ndarray) -> None:
    own = f"{folder}/.{uuid.uuid4().hex}"
    a.tofile(own)
    os.replace(own, f"{folder}/{name}")


def mapped(folder: str, name: str, dtype, n: int) -> np.ndarray:
    """A file of n values, mapped; one that isn't there whole is an error, as its values would be lost silently."""
    path, want = f"{folder}/{name}", n * np.dtype(dtype).itemsize
    if (size := os.path.getsize(path)) != want:
        raise OSError(f"{path} has {size} bytes in place of {want}")
    return np.memmap(path, dtype, "r") if n else np.zeros(0, dtype)


def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows sorted by (shard, kind) to one sum of blocks for each; held blocks are merged from time to time."""
    at, keys, counts = None, [], []

    def total():
        return summed(np.concatenate(keys), np.concatenate(counts))

    for b in batches:
        for s, k, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if (s, k) != at:
                if at:
                    yield *at, *total()
                at, keys, counts = (s, k), [], []
            x, c = unpack(p.as_py())
            keys.append(x)
            counts.append(c)
            if sum(map(len, keys)) > 2 * max(HELD, len(keys[0])):
                x, c = total()
                keys, counts = [x], [c]
    if at:
        yield *at, *total()
