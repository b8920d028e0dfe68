"""Vectorised byte-level text primitives of the corpus operators.

A column of texts arrives as Arrow batches. Its bytes lie in one buffer, so words are found and
hashed for a whole batch by a few NumPy passes instead of a Python loop over words. Temporary arrays
are bounded: a batch is cut into pieces of about ``PIECE`` bytes at white space; only a single word
longer than that makes a longer piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_M = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0xD6E8FEB86659FD93
_POW: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit integers."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64, n of each at least."""
    if not _POW or len(_POW[0]) < n:
        size = max(n, PIECE + 4096)
        out = []
        for base in (_ODD, pow(_ODD, -1, 1 << 64)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 4 * PIECE:  # one giant word: not kept
            return out[0], out[1]
        _POW[:] = out
    return _POW[0], _POW[1]


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and where each row begins (one more at the end); null is empty."""
    col = col.cast(pa.large_binary()) if not pa.types.is_large_binary(col.type) else col
    if col.null_count:
        col = col.fill_null(b"")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64, n + 1, col.offset * 8) if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def _cuts(buf: np.ndarray, off: np.ndarray) -> list[int]:
    """Bounds of pieces: at row starts or, inside a long row, after white space."""
    out, at, end = [0], 0, len(buf)
    while end - at > PIECE:
        i = int(np.searchsorted(off, at + PIECE, "right")) - 1
        cut = int(off[i])
        if cut <= at:
            sp = np.flatnonzero(_SPACE[buf[at : at + PIECE]])
            if len(sp):
                cut = at + int(sp[-1]) + 1
            else:  # a word longer than a piece
                cut, step = at + PIECE, PIECE
                stop = int(off[min(i + 1, len(off) - 1)])
                while cut < stop:
                    sp = np.flatnonzero(_SPACE[buf[cut : min(stop, cut + step)]])
                    if len(sp):
                        cut += int(sp[0]) + 1
                        break
                    cut = min(stop, cut + step)
        out.append(cut)
        at = cut
    out.append(end)
    return out


def hash_words(buf: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all rows in order, and where each row's words begin."""
    off = np.asarray(off, np.int64)
    words, first = [], []
    cuts = _cuts(buf, off)
    for lo, hi in zip(cuts, cuts[1:]):
        if hi <= lo:
            continue
        b = buf[lo:hi]
        b = _LOWER[b] if lower else b
        n = len(b)
        ink = ~_SPACE[b]
        brk = np.zeros(n + 1, bool)
        inner = off[np.searchsorted(off, lo) : np.searchsorted(off, hi, "right")] - lo
        brk[inner] = True
        brk[0] = brk[n] = True
        gap = brk.copy()
        gap[1:] |= ~np.append(ink, True)[:-1]
        starts = np.flatnonzero(ink & gap[:-1])
        gap = brk
        gap[:-1] |= ~ink
        ends = np.flatnonzero(ink & gap[1:]) + 1
        if not len(starts):
            continue
        p, inv = _powers(n)
        c = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
        h = (c[ends] - c[starts]) * inv[starts]
        words.append(mix(h ^ ((ends - starts).astype(np.uint64) * _M)))
        first.append(starts + lo)
    if not words:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(words), np.searchsorted(np.concatenate(first), off).astype(np.int64)


def ngrams(words: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside a row, in order, and where each row's runs begin."""
    k = len(words) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    h = words[:k].copy()
    for i in range(1, n):
        h = mix(h) + words[i : i + k] * (_A + np.uint64(2 * i))
    h = mix(h ^ np.uint64(n))
    ok = np.ones(k, bool)
    for o in off[1:-1]:  # runs that would reach over the end of a row
        ok[max(0, o - n + 1) : o] = False
    counts = np.maximum(np.diff(off) - n + 1, 0)
    return h[ok], np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], text: int, most: int = 4 * PIECE) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that one holds at most so many bytes of text, or one row."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = column_bytes(b.column(text))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield b.slice(at, to - at)
            at = to
