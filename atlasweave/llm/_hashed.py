"""Hashed byte n-grams of texts, summed over a table of values for each document or counted for training."""

from __future__ import annotations

import numpy as np

from atlasweave.llm._text import _LOWER

ORDERS = (3, 4)
CHUNK = 1 << 18


def grams(b: np.ndarray, bits: int, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each position (fewer by order - 1)."""
    k = len(b) - order + 1
    if k <= 0:
        return np.zeros(0, np.uint32)
    x = b[:k].astype(np.uint32)
    for i in range(1, order):
        x |= b[i : i + k].astype(np.uint32) << np.uint32(8 * i)
    return (x * np.uint32(2654435761) + np.uint32(order * 0x9E3779B1 & 0xFFFFFFFF)) >> np.uint32(32 - bits)


def _normal(b: np.ndarray, lower: bool) -> np.ndarray:
    return _LOWER[b] if lower else b


def sums(buf: np.ndarray, off: np.ndarray, table: np.ndarray, bits: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of bytes: the sum of the table's rows over its n-grams, and their number. Long rows go chunk by chunk."""
    out = np.zeros((len(off) - 1, table.shape[1]))
    size = np.diff(off)
    count = sum(np.maximum(size - n + 1, 0) for n in ORDERS)
    step = max(4096, CHUNK * 4 // max(4, table.shape[1]))
    wide = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    for lo in range(0, len(buf), step):
        hi = min(len(buf), lo + step)
        b = _normal(buf[lo : hi + max(ORDERS)], lower)
        first, last = int(np.searchsorted(off, lo, "right")) - 1, int(np.searchsorted(off, hi, "left"))
        ends = off[1:][first:last] - lo
        for n in ORDERS:
            h = grams(b, bits, n)[: hi - lo].astype(np.int64)
            for back in range(1, n):  # n-grams that would reach over the end of a row
                at = ends - back
                h[at[(at >= 0) & (at < len(h))]] = len(table)
            if not len(h):
                continue
            v = wide[h]
            starts = np.maximum(off[first:last] - lo, 0)
            full = np.flatnonzero((np.minimum(ends, len(h)) > starts) & (starts < len(h)))
            if len(full):
                out[first + full] += np.add.reduceat(v, starts[full], axis=0)
    return out, count


def packed(text: bytes, bits: int, lower: bool) -> tuple[bytes, bytes]:
    """The distinct buckets of one text (at most 16 bits) and their counts in the narrowest type, as little-endian bytes.

    With both, a text takes half the bytes of its shares on the way to the driver.
    """
    b = _normal(np.frombuffer(text, np.uint8), lower)
    c = np.bincount(np.concatenate([grams(b, bits, n) for n in ORDERS]), minlength=1)
    at = np.flatnonzero(c)
    c = c[at]
    return at.astype("<u2").tobytes(), c.astype("<u2" if c.max(initial=0) < 1 << 16 else "<u8").tobytes()


def unpacked(ids: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets and their shares of all n-grams, for training."""
    at = np.frombuffer(ids, "<u2")
    c = np.frombuffer(counts, "<u2" if len(counts) == len(ids) else "<u8").astype(np.int64)
    return at, (c / max(1, int(c.sum()))).astype(np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
