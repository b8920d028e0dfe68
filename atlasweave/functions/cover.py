"""Coverings of polygons by cells: recursive subdivision from the faces of the cube, for many polygons at once.

A cell is judged by its box in degrees, which holds it: a cell whose box meets no edge lies wholly inside or outside. So a
covering is complete (no point of a polygon is left out), and a cell told to be full is wholly inside. Cells come at the
coarsest level first; those that aren't full are cut into finer ones, the cheapest first, while a polygon keeps at most the
number of cells that it may have. A polygon too wide for the coarsest level asked for gets cells of still coarser levels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from atlasweave import schema as S
from atlasweave.functions.geo import _from_ij

FLAT = 2_000_000  # pairs of cells and edges compared at once
EDGES = 50_000  # edges of polygons covered together
FEW = 4  # up to so many cells of a part are compared with its box in place of its edges
_EPS = 1e-9  # degrees

Polygon = list[list[np.ndarray]]


def ladder(levels: tuple[int, ...]) -> tuple[int, ...]:
    """The levels asked for, and every second coarser one for polygons too wide for them."""
    low = min(levels)
    return (*range(low % 2 or 2, low, 2), *sorted(levels))


def _uv(st: np.ndarray) -> np.ndarray:
    return np.where(st >= 0.5, (4 * st * st - 1) / 3, (1 - 4 * (1 - st) ** 2) / 3)


def boxes(face: np.ndarray, i: np.ndarray, j: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(west, south, east, north) in degrees that hold cells of a level (1 or more)."""
    n = float(1 << level)
    u0, u1, v0, v1 = _uv(i / n), _uv((i + 1) / n), _uv(j / n), _uv((j + 1) / n)
    # sides of the cube around the equator: one coordinate tells the longitude, the other the latitude
    turned = face >= 3
    a0, a1 = np.where(turned, v0, u0), np.where(turned, v1, u1)  # towards the east
    b0, b1 = np.where(turned, -u1, v0), np.where(turned, -u0, v1)  # towards the north
    base = np.select([face == 0, face == 1, face == 3, face == 4], [0.0, 90.0, 180.0, -90.0])
    west, east = base + np.degrees(np.arctan(a0)), base + np.degrees(np.arctan(a1))
    near, far = np.where((a0 < 0) & (a1 > 0), 0, np.minimum(np.abs(a0), np.abs(a1))), np.maximum(np.abs(a0), np.abs(a1))
    south = np.degrees(np.arctan(b0 / np.sqrt(1 + np.where(b0 > 0, far, near) ** 2)))
    north = np.degrees(np.arctan(b1 / np.sqrt(1 + np.where(b1 > 0, near, far) ** 2)))
    over = west >= 180 - 1e-12  # the half of the face behind the antimeridian
    west, east = np.where(over, west - 360, west), np.where(over, east - 360, east)
    # sides around the poles: the distance from the middle tells the latitude
    polar = (face == 2) | (face == 5)
    if polar.any():
        p = np.flatnonzero(polar)
        corners = np.stack([np.stack([u[p], v[p]]) for u in (u0, u1) for v in (v0, v1)])  # 4, 2, cells
        r = np.hypot(corners[:, 0], corners[:, 1])
        close = np.hypot(np.minimum(np.abs(u0[p]), np.abs(u1[p])), np.minimum(np.abs(v0[p]), np.abs(v1[p])))
        with np.errstate(divide="ignore"):
            low, high = np.degrees(np.arctan(1 / r.max(axis=0))), np.degrees(np.arctan(1 / close))
        top = face[p] == 2
        south[p], north[p] = np.where(top, low, -high), np.where(top, high, -low)
        angle = np.degrees(np.where(top, np.arctan2(-corners[:, 1], -corners[:, 0]), np.arctan2(corners[:, 0], corners[:, 1])))
        mid = np.degrees(np.where(top, np.arctan2(-(v0 + v1)[p], -(u0 + u1)[p]), np.arctan2((u0 + u1)[p], (v0 + v1)[p])))
        off = np.where(r > 0, (angle - mid + 180) % 360 - 180, 0)
        west[p], east[p] = mid + off.min(axis=0), mid + off.max(axis=0)
    return west, south, east, north


def spans(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges start .. start + n, one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else np.zeros(0, np.int64)


def crossings(a: np.ndarray, b: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """How often edges a-b cross the way from (x0, y0) along y0 to x1, then along x1 to y1, pair by pair (0 to 2)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (y0 - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
        y = a[:, 1] + (x1 - a[:, 0]) / (b[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])
        flat = ((a[:, 1] > y0) != (b[:, 1] > y0)) & ((x0 < x) != (x1 < x))
        steep = ((a[:, 0] > x1) != (b[:, 0] > x1)) & ((y0 < y) != (y1 < y))
    return flat.astype(np.int64) + steep


@dataclass
class Edges:
    """Edges of all parts (an outer ring and its holes): ends, where each part's begin, whose part it is, its box."""

    a: np.ndarray  # x, y
    b: np.ndarray
    at: np.ndarray  # one more at the end
    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, shapes: list[Polygon]) -> Edges:
        a, b, n, owner = [], [], [], []
        for k, polygons in enumerate(shapes):
            for rings in polygons:
                west, east = min(float(r[:, 0].min()) for r in rings), max(float(r[:, 0].max()) for r in rings)
                turns = [0, *([-360] if east >= 180 - _EPS else []), *([360] if west <= -180 + _EPS else [])]
                own = [r + np.array([turn, 0.0]) for turn in turns for r in rings]
                a += own
                b += [np.roll(r, -1, axis=0) for r in own]
                n.append(sum(map(len, own)))
                owner.append(k)
        none = np.zeros((0, 2))
        a, b, at = np.concatenate([none, *a]), np.concatenate([none, *b]), np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        low, high = (f.reduceat(a, at[:-1], axis=0) if len(n) else none for f in (np.minimum, np.maximum))
        return cls(a, b, at, np.array(owner, np.int64), low, high)

    def meet(self, edge: np.ndarray, box: tuple[np.ndarray, ...]) -> np.ndarray:
        """Whether edges meet boxes, pair by pair."""
        w, s, e, n = box
        a, b = self.a[edge], self.b[edge]
        half = (b - a) / 2
        mid = (a + b) / 2
        hx, hy = (e - w) / 2 + _EPS, (n - s) / 2 + _EPS
        mx, my = mid[:, 0] - (w + e) / 2, mid[:, 1] - (s + n) / 2
        ax, ay = np.abs(half[:, 0]), np.abs(half[:, 1])
        return (np.abs(mx) <= hx + ax) & (np.abs(my) <= hy + ay) & (np.abs(mx * half[:, 1] - my * half[:, 0]) <= hx * ay + hy * ax + _EPS)


@dataclass
class Cells:
    """Cells of many parts: part, face, i, j, level; whether full, or not yet compared with the edges (lazy); whether the middle
    of its box is inside; and the edges that meet those that are neither full nor lazy (pairs)."""

    part: np.ndarray
    face: np.ndarray
    i: np.ndarray
    j: np.ndarray
    level: np.ndarray
    full: np.ndarray
    lazy: np.ndarray
    mid: np.ndarray
    pair_cell: np.ndarray
    pair_edge: np.ndarray

    def ids(self) -> np.ndarray:
        out = np.zeros(len(self.part), np.int64)
        for level in np.unique(self.level).tolist():
            m = self.level == level
            out[m] = _from_ij(self.face[m], self.i[m] << (30 - level), self.j[m] << (30 - level), level)
        return out

    def take(self, keep: np.ndarray) -> Cells:
        """The cells at places, or those of a mask."""
        at = np.flatnonzero(keep) if keep.dtype == bool else keep
        new = np.full(len(self.part), -1, np.int64)
        new[at] = np.arange(len(at))
        pairs = new[self.pair_cell] >= 0
        return Cells(*(getattr(self, f)[at] for f in _FIELDS), new[self.pair_cell[pairs]], self.pair_edge[pairs])

    def boxes(self) -> tuple[np.ndarray, ...]:
        out = [np.zeros(len(self.part)) for _ in range(4)]
        for level in np.unique(self.level).tolist():
            m = self.level == level
            for o, x in zip(out, boxes(self.face[m], self.i[m], self.j[m], level)):
                o[m] = x
        return tuple(out)


_FIELDS = ("part", "face", "i", "j", "level", "full", "lazy", "mid")


def _joined(parts: list[Cells]) -> Cells:
    before = np.concatenate([[0], np.cumsum([len(p.part) for p in parts])])
    return Cells(*(np.concatenate([getattr(p, f) for p in parts]) for f in _FIELDS), np.concatenate([p.pair_cell + b for p, b in zip(parts, before)]), np.concatenate([p.pair_edge for p in parts]))


def _quarters(c: Cells) -> tuple[Cells, np.ndarray]:
    """The four quarters of each cell, and which cell each is of; nothing is known of them."""
    of, k = np.repeat(np.arange(len(c.part)), 4), np.tile(np.arange(4), len(c.part))
    none = np.zeros(0, np.int64)
    return Cells(c.part[of], c.face[of], c.i[of] * 2 + (k & 1), c.j[of] * 2 + (k >> 1), c.level[of] + 1, c.full[of], c.lazy[of], c.mid[of], none, none), of


def _cut(c: Cells, e: Edges, last: bool) -> tuple[Cells, np.ndarray]:
    """The quarters of cells that aren't full, without those outside, and which cell each is of.

    As long as a part has few cells they are compared with its box alone; ``last`` ends that.
    """
    q, of = _quarters(c)
    if not len(of):
        return q, of
    box = boxes(q.face, q.i, q.j, int(q.level[0]))
    w, s, east, n = box
    here = ~q.lazy | (w <= e.high[q.part, 0] + _EPS) & (east >= e.low[q.part, 0] - _EPS) & (s <= e.high[q.part, 1] + _EPS) & (n >= e.low[q.part, 1] - _EPS)
    few = np.bincount(q.part[q.lazy & here], minlength=len(e.owner)) <= FEW
    stay = q.lazy & here & few[q.part] & (not last)
    met = q.lazy & here & ~stay
    own = np.flatnonzero(met)
    size = e.at[q.part[own] + 1] - e.at[q.part[own]]
    # a cell that is compared for the first time is compared with all edges, from a point outside of the part's box
    mx, my = (w + east) / 2, (s + n) / 2
    odd = np.zeros(len(of), np.int64)
    cells, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def compare(cell: np.ndarray, edge: np.ndarray, x0: np.ndarray, y0: np.ndarray) -> None:
        hit = e.meet(edge, tuple(x[cell] for x in box))
        cells.append(cell[hit])
        edges.append(edge[hit])
        np.add.at(odd, cell, crossings(e.a[edge], e.b[edge], x0, y0, mx[cell], my[cell]))

    for at in _shares(size):
        k, m = own[at], size[at]
        cell = np.repeat(k, m)
        compare(cell, spans(e.at[q.part[k]], m), e.low[q.part[cell], 0] - 1, my[cell])
    pw, ps, pe, pn = (x[of] for x in boxes(c.face, c.i, c.j, int(c.level[0]))) if c.level[0] else (w, s, east, n)
    for at in range(0, len(c.pair_cell), FLAT // 4):
        cell = (c.pair_cell[at : at + FLAT // 4, None] * 4 + np.arange(4)).ravel()
        compare(cell, np.repeat(c.pair_edge[at : at + FLAT // 4], 4), ((pw + pe) / 2)[cell], ((ps + pn) / 2)[cell])
    q.mid = np.where(met, False, q.mid) ^ (odd & 1).astype(bool)
    q.pair_cell, q.pair_edge = np.concatenate(cells), np.concatenate(edges)
    edged = np.zeros(len(of), bool)
    edged[q.pair_cell] = True
    q.lazy = stay
    q.full = ~edged & ~stay & here & q.mid
    keep = np.flatnonzero(edged | stay | q.full)
    return q.take(keep), of[keep]


def _shares(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places in runs whose sizes sum up to about FLAT."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + FLAT, "right")))
        yield np.arange(at, to)
        at = to


def _sound(polygons: Polygon) -> Polygon:
    """Rings with finite coordinates on the globe; a part without such an outer ring goes, as does a hole."""
    ok = lambda r: len(r) and np.isfinite(r).all() and (np.abs(r[:, 1]) <= 90).all() and (np.abs(r[:, 0]) <= 360).all()
    return [[r for r in rings if ok(r)] for rings in polygons if rings and ok(rings[0])]


def _cover(shapes: list[Polygon], levels: tuple[int, ...], most: int, interior: bool) -> tuple[Cells, Edges]:
    e = Edges.of([_sound(p) for p in shapes])
    parts = np.repeat(np.arange(len(e.owner)), 6)
    zero, none = np.zeros(len(parts), np.int64), np.zeros(0, np.int64)
    false = np.zeros(len(parts), bool)
    at = Cells(parts, np.tile(np.arange(6), len(e.owner)), zero, zero, zero, false, ~false, false, none, none)
    steps, level, done = ladder(levels), 0, []
    per_shape = lambda c: np.bincount(e.owner[c.part], minlength=len(shapes))
    for step in steps:
        # ``at`` holds cells that aren't full; each is replaced by those at this step that it is cut into
        new, origin = at, np.arange(len(at.part))
        while level < step:
            open_, whole = np.flatnonzero(~new.full), np.flatnonzero(new.full)
            cut, of = _cut(new.take(open_), e, level + 1 == steps[-1])
            split, of_whole = _quarters(new.take(whole))
            origin = np.concatenate([origin[open_][of], origin[whole][of_whole]])
            new = _joined([cut, split])
            level += 1
        if step > steps[0] and not interior:
            # the cheapest cuts first, while the shape keeps to its number of cells
            more = np.bincount(origin, minlength=len(at.part)) - 1
            have = per_shape(at) + sum(map(per_shape, done), np.zeros(len(shapes), np.int64))
            order = np.lexsort((more, e.owner[at.part]))
            shape, total = e.owner[at.part[order]], np.cumsum(more[order])
            begin = np.searchsorted(shape, shape)
            fits = np.zeros(len(at.part), bool)
            fits[order] = have[shape] + total - (total[begin] - more[order][begin]) <= most
            done.append(at.take(~fits))
            new = new.take(fits[origin])
        done.append(new.take(new.full))
        at = new.take(~new.full)
        if interior:  # the largest full cells are wanted; those that are cut on stay within bounds
            have, open_ = sum(map(per_shape, done)), per_shape(at)
            at = at.take((have < most)[e.owner[at.part]] & (open_ <= 16 * most)[e.owner[at.part]])
        if not len(at.part):
            break
    if interior:
        out = _joined(done)
        order = np.lexsort((out.j, out.i, out.face, out.level, e.owner[out.part]))
        shape = e.owner[out.part[order]]
        return out.take(order[np.arange(len(order)) - np.searchsorted(shape, shape) < most]), e
    return _joined([*done, at]), e


def cover_many(shapes: list[Polygon], levels: tuple[int, ...] = S.REVGEO_LEVELS, most: int = S.REVGEO_MAX_CELLS, interior: bool = False) -> Iterator[tuple[int, Cells, Edges]]:
    """Coverings of shapes, in groups of a bounded number of edges: (number of the group's first shape, cells, edges).

    The parts of a shape are covered each by itself, so a cell may come for several. Shapes without a sound part have no cells.
    """
    at = 0
    while at < len(shapes):
        size, to = 0, at
        while to < len(shapes) and (to == at or size < EDGES):
            size += sum(len(r) for rings in shapes[to] for r in rings)
            to += 1
        yield at, *_cover(shapes[at:to], levels, most, interior)
        at = to


def cover(polygons: Polygon, levels: tuple[int, ...] = S.REVGEO_LEVELS, most: int = S.REVGEO_MAX_CELLS, interior: bool = False) -> list[int]:
    """The cells of one shape: a complete covering, or full cells alone."""
    return sorted({c for _, cells, _ in cover_many([polygons], levels, most, interior) for c in cells.ids().tolist()})
