"""Coverings against sampling, and reverse geocoding against whole polygons."""

import numpy as np
import pytest

from atlasweave import schema as S
from atlasweave.functions import cover as C
from atlasweave.functions import geo
from atlasweave.plans import reverse

NS = 1 << 56


def box(w, s, e, n):
    return [[np.array([[w, s], [e, s], [e, n], [w, n], [w, s]], float)]]


def star():
    t = np.linspace(0, 2 * np.pi, 2000)
    r = 10 * (1 + 0.2 * np.sin(40 * t))
    return [[np.stack([20 + r * np.cos(t), 45 + r * np.sin(t)], axis=1)]]


SHAPES = {
    "very wide": box(-180, 41, 180, 82), "half of the globe": box(-180, 0, 180, 90), "an ocean": box(-100, 0, 60, 40), "pole": box(-180, 80, 180, 90), "south": box(10, -90, 50, -70),
    "over the antimeridian": box(170, -20, 180, 10) + box(-180, -20, -170, 10), "beyond it": box(170, -20, 190, 10), "tiny": [[geo.circle(40, -73, 100)]], "5 km": [[geo.circle(64.1, -21.9, 5000)]],
    "a hole": [[box(0, 0, 10, 10)[0][0], box(3, 3, 7, 7)[0][0]]], "star": star(), "overlapping parts": box(0, 0, 2, 2) + box(1, 1, 3, 3), "corner of faces": box(44, 34, 46, 36),
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize(("levels", "most"), [(S.REVGEO_LEVELS, 1000), ((8,), 60), (tuple(range(4, 15)), 50)])
def test_coverings_are_complete(name, levels, most):
    rng, shape = np.random.default_rng(2), SHAPES[name]
    r = np.concatenate([x for rings in shape for x in rings])
    (w, s), (e, n) = r.min(axis=0), r.max(axis=0)
    x, y = rng.uniform(w, e, 20_000), rng.uniform(s, n, 20_000)
    inside = geo.contains(shape, x, y)
    [(_, cells, _)] = C.cover_many([shape], levels, most)
    ids = cells.ids()
    assert inside.any() and len(set(ids.tolist())) <= max(most, 24 * 4)
    assert set(geo.levels_of(ids).tolist()) <= set(C.ladder(levels))
    hit, full = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for level in C.ladder(levels):
        own = geo.cell_ids(y, (x + 180) % 360 - 180, level)
        hit |= np.isin(own, ids)
        full |= np.isin(own, ids[cells.full])
    assert not (inside & ~hit).any() and not (full & ~inside).any()
    # cells of one part are disjoint
    if len(shape) == 1:
        assert len(np.unique(ids)) == len(ids) and not any(np.isin(geo.parents_at(ids[geo.levels_of(ids) > up], up), ids).any() for up in C.ladder(levels))


@pytest.mark.parametrize("name", ["5 km", "star", "a hole", "half of the globe"])
def test_interior_coverings(name):
    [(_, cells, _)] = C.cover_many([SHAPES[name]], tuple(range(4, 19)), 100, interior=True)
    assert cells.full.all() and 20 < len(cells.part) <= 100
    w, s, e, n = cells.boxes()
    for x, y in ((w, s), (w, n), (e, s), (e, n)):
        assert geo.contains(SHAPES[name], x * (1 - 1e-12), y * (1 - 1e-12)).all()


def test_boxes_hold_their_cells():
    rng = np.random.default_rng(3)
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, 20_000))), rng.uniform(-180, 180, 20_000)
    leaf = geo.cell_ids(lat, lng)
    for level in (1, 2, 7, 12):
        ids = geo.parents_at(leaf, level)
        # each cell by its face and place, from a covering of its points
        for k in range(0, 20_000, 4000):
            [(_, cells, _)] = C.cover_many([[[np.array([[lng[k], lat[k]]])]]], (level,), 10)
            assert ids[k] in cells.ids()
            w, s, e, n = (x[cells.ids() == ids[k]][0] for x in cells.boxes())
            own = ids == ids[k]
            assert ((lng[own] >= w - 1e-9) & (lng[own] <= e + 1e-9) & (lat[own] >= s - 1e-9) & (lat[own] <= n + 1e-9)).all()


def test_odd_shapes():
    assert C.cover([]) == [] and C.cover([[np.zeros((0, 2))]]) == [] and C.cover(box(0, 80, 1, 91)) == [] and C.cover([[np.array([[np.nan, 1], [2, 3], [4, 1]])]]) == []
    point = C.cover([[np.array([[10.0, 20.0]])]], (12,))
    assert int(geo.cell_ids(np.array([20.0]), np.array([10.0]), 12)[0]) in point and len(point) <= 2


def test_areas():
    square = np.array([[0, 0], [10, 0], [10, 10], [0, 10]], float)
    ring = np.concatenate([square, square[:1]])
    assert geo.overlap([[ring]], square / 2) == (25, 100) and geo.overlap([[ring, ring * 0.2 + 1]], square[::-1] / 2)[0] == pytest.approx(21)
    assert geo.overlap([[ring]], square / 100 + 4) == (pytest.approx(0.01), 100) and geo.overlap([[ring]], square + 20)[0] == 0
    assert geo.area(geo.clip_box(ring, 5, 5, 20, 20)) == 25


def test_reverse_geocode_agrees_with_whole_polygons(spark):
    shapes = {NS + k: s for k, s in enumerate(SHAPES.values())}
    rng = np.random.default_rng(4)
    points = [(k, float(y), float(x)) for k, (x, y) in enumerate(zip(rng.uniform(-180, 180, 600), np.degrees(np.arcsin(rng.uniform(-1, 1, 600)))))]
    points += [(1000 + k, float(y), float(x)) for k, (x, y) in enumerate(zip(rng.uniform(-2, 34, 600), rng.uniform(-2, 58, 600)))] + [(5000, 0.5, 180.0), (5001, 0.5, -180.0), (5002, 90.0, 12.0), (5003, 85.0, -180.0), (5004, 85.0, 180.0)]
    places = spark.createDataFrame([(f, "US", S.TOWN, 0.0, 0.0, 1, 0, [], [], True, True) for f in shapes], S.FEATURES)
    table = spark.createDataFrame([(f, geo.write_wkb(s)) for f, s in shapes.items()] + [(NS + 99, b"bad"), (NS + 98, None)], "fid bigint, wkb binary")
    index = reverse.cell_index(table).written()
    got = {}
    for r in reverse.reverse_geocode(spark.createDataFrame(points, "qid bigint, lat double, lng double"), index, places).collect():
        got.setdefault(r["qid"], set()).add(r["fid"])
    for k, y, x in points[:-5]:
        want = {f for f, s in shapes.items() if any(geo.contains(s, [x + t], [y])[0] for t in (0, 360, -360))}
        assert got.get(k, set()) == want, k
    # on the antimeridian, where shapes end or go on
    assert {list(SHAPES)[f - NS] for f in got[5000]} >= {"beyond it"} and got[5000] == got[5001] and got[5003] == got[5004]
    # boxes: over the antimeridian, inside, and together with a radius
    asked = [(1, None, None, None, -5.0, 175.0, 5.0, -175.0), (2, None, None, None, 4.0, 4.0, 5.0, 5.0), (3, 1.0, 1.0, 10.0, 0.0, 0.0, 1.0, 1.0), (4, 5.0, 5.0, None, 1.0, 1.0, 2.0, 2.0), (5, 5.0, 5.0, None, 2.0, 1.0, 1.0, 2.0)]
    rows = reverse.reverse_geocode(spark.createDataFrame(asked, "qid bigint, lat double, lng double, radius double, south double, west double, north double, east double"), index, places).collect()
    by = {(r["qid"], list(SHAPES)[r["fid"] - NS]): r["request_share"] for r in rows}
    # the largest box is given twice and half of the globe lies north of the equator
    assert by[1, "over the antimeridian"] == pytest.approx(100) and by[1, "beyond it"] == pytest.approx(100) and by[1, "half of the globe"] == pytest.approx(50)
    assert {k[0] for k in by} == {1, 2, 4} and (2, "a hole") not in by and by[4, "a hole"] == pytest.approx(100) and by[4, "overlapping parts"] == pytest.approx(100)


def test_coverings_of_bad_shapes(spark):
    df = spark.createDataFrame([(1, b"bad"), (2, geo.write_wkb(box(0, 0, 1, 1))), (3, None), (4, geo.write_wkb(box(0, 0, 30, 30)))], "fid bigint, wkb binary")
    got = {r["fid"]: r["cells"] for r in reverse.coverings(df, (4, 12)).collect()}
    assert got[1] == got[3] == [] and 4 <= len(got[2]) <= 50 and 4 <= len(got[4]) <= 50
    inner = {r["fid"]: r["cells"] for r in reverse.coverings(df, S.INTERIOR_LEVELS, S.INTERIOR_MAX_CELLS, interior=True).collect()}
    assert inner[1] == [] and 10 < len(inner[2]) <= 100


def test_country_codes(spark):
    rows = [(NS + 1, "AA", S.COUNTRY, 5.0, 5.0, 1, 0, [], [], True, True), (NS + 2, "BB", S.TOWN, 20.0, 20.0, 1, 0, [], [], False, True), (NS + 3, "CC", S.TOWN, 20.0, 21.0, 1, 0, [], [], False, True)]
    places = spark.createDataFrame(rows, S.FEATURES)
    index = reverse.cell_index(spark.createDataFrame([(NS + 1, geo.write_wkb(box(0, 0, 10, 10)))], "fid bigint, wkb binary")).written()
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 20.01, 20.01), (3, 20.02, 20.98), (4, 91.0, 0.0), (5, None, 1.0)], "qid bigint, lat double, lng double")
    assert dict(map(tuple, reverse.country_codes(points, index, places).collect())) == {1: "AA", 2: "BB", 3: "CC"}


def test_equal_geometries_are_covered_once(spark):
    shapes = [box(0, 0, 1, 1), box(0.5, 0.5, 2, 2), box(40, 40, 41, 41)]
    table = spark.createDataFrame([(NS + k, geo.write_wkb(shapes[k % 3])) for k in range(60)] + [(NS + 98, b"bad"), (NS + 99, None)], "fid bigint, wkb binary")
    places = spark.createDataFrame([(NS + k, "US", S.TOWN, k / 50, k / 50, 1, 0, [], [], True, True) for k in range(60)], S.FEATURES)
    asked = [(k, *[(0.2, 0.2, None), (0.7, 0.7, None), (0.7, 0.7, 900.0), (0.7, 0.7, -1.0), (1.5, 1.5, 400.0), (9.0, 9.0, None)][k % 6]) for k in range(120)]
    points = spark.createDataFrame(asked, "qid bigint, lat double, lng double, radius double")
    whole, shared = reverse.cell_index(table).written(), reverse.shared_index(table)
    assert shared.cells.select("fid").distinct().count() == 3 and shared.copies.count() == 61
    assert 19 * shared.cells.count() < whole.cells.count()
    for limit in (None, 5):
        rows = [sorted(map(tuple, reverse.reverse_geocode(points, i, places, limit).collect())) for i in (whole, shared)]
        assert rows[0] == rows[1] and {r[0] % 6 for r in rows[0]} == {0, 1, 2, 3, 4}
        if limit is None:
            assert len(rows[0]) == 20 * (20 + 40 + 40 + 40 + 20)


def test_circles_in_batches():
    rng = np.random.default_rng(6)
    lat, lng = rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)
    assert geo.circles_wkb(lat, lng, 5000.0) == [geo.write_wkb([[geo.circle(a, b, 5000.0)]]) for a, b in zip(lat, lng)]


def test_country_codes_of_a_shared_index(spark):
    wkb = geo.write_wkb(box(0, 0, 10, 10))
    rows = [(NS + 1, "BB", S.TOWN, 5.0, 5.0, 1, 0, [], [], True, True), (NS + 2, "AA", S.COUNTRY, 5.0, 5.0, 1, 0, [], [], True, True)]
    index = reverse.shared_index(spark.createDataFrame([(NS + 1, wkb), (NS + 2, wkb)], "fid bigint, wkb binary"))
    points = spark.createDataFrame([(1, 3.0, 4.0), (2, 3.0, 4.0)], "qid bigint, lat double, lng double")
    assert dict(map(tuple, reverse.country_codes(points, index, spark.createDataFrame(rows, S.FEATURES)).collect())) == {1: "AA", 2: "AA"}
