"""Names, ids and geometry."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo, ids, names
from atlasweave.operators import enrich, indexes


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).collect()[0]


def test_normalize_and_tokens(spark):
    r = one(spark, a=names.normalize(F.lit("St. Mary's–Town,  (Old)\tcity!")), b=names.tokens(F.lit("a, b  c,")), c=names.normalize(F.lit("İstanbul"), True))
    assert (r["a"], r["b"], r["c"]) == ("st marystown old city", ["a", "b", "c"], "istanbul")


def test_name_rules(spark):
    n = F.lit
    r = one(
        spark, d=names.apply_deletes(n("County of Kings County"), ["County", "County of"]), k=names.apply_deletes(n("Countyside"), ["County"]), w=names.apply_rewrites(n("Mount Gaß"), [(r"Mount\b", ["Mt", "Mtn"])]),
        s=names.shortest(n("Province of Cebu"), n("PH"), [("*", "Province of", ""), ("US", "Cebu", "x")]), h=names.country_hack(n("Region Lima"), n("PE"), n(8)), p=names.polygon_names(n("A (B), C/D")), ro=names.romanian(n("Iaşi Ţară")), x=names.prefixes(n("abc"), 5),
    )
    assert (r["d"], r["k"], r["w"]) == ("Kings", "Countyside", ["Mount Gaß", "Mt Gaß", "Mtn Gaß", "Mount Gass"])
    assert (r["s"], r["h"], r["ro"], r["x"]) == ("Cebu", "Lima Region", "Iași Țară", ["a", "ab", "abc"])
    assert set(r["p"]) == {"A", "B", "C", "D"}


def test_jaro_winkler():
    for a, b, want in (("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("", "", 1), ("a", "", 0), ("same", "same", 1)):
        assert names.jaro_winkler(a, b) == pytest.approx(want, abs=1e-4)


def test_best_name_and_highlight(spark):
    rows = [(1, [("Köln", "de", S.PREFERRED), ("Cologne", "en", S.PREFERRED), ("CGN", "abbr", S.ABBREVIATION), ("Old", "en", S.HISTORIC)], "L.A. Town", "la")]
    df = spark.createDataFrame(rows, "i int, n array<struct<name: string, lang: string, flags: int>>, t string, q string")
    r = df.select(names.best_name("n" and F.col("n"), F.lit("de")).alias("de"), names.best_name(F.col("n"), F.lit("fr")).alias("fr"), names.best_name(F.col("n"), F.lit("en"), F.lit(True)).alias("short"), names.highlight("t", "q").alias("h")).collect()[0]
    assert (r["de"], r["fr"], r["short"], r["h"]) == ("Köln", "Cologne", "CGN", "<b>L.A.</b> Town")


def test_ids(spark):
    fid = (1 << 56) + 5
    r = one(spark, f=ids.feature_id(1, F.lit(5)), p=ids.parse_id(F.lit("geonameid:5")), l=ids.parse_id(F.lit(str(fid))), b=ids.parse_id(F.lit("5"), "geonameid"), x=ids.parse_id(F.lit("nope:5")), y=ids.parse_id(F.lit("12ab34")), q=ids.namespace_order(F.lit(fid)))
    assert (r["f"], r["p"], r["l"], r["b"], r["x"], r["y"], r["q"]) == (fid, fid, fid, fid, None, None, 3)


@pytest.mark.parametrize(("cc", "code", "back"), [("US", "10003", "10003"), ("JP", "151-0064", "151-0064"), ("FR", "75008 CEDEX", "75008 CEDEX"), ("FR", "75008 CEDEX 2", "75008 CEDEX 2"), ("GB", "SW1A 1AA", "SW1A 1AA"), ("US", "1234567890", None), ("XX", "1", None), ("US", "é", None)])
def test_postal_ids(spark, cc, code, back):
    r = one(spark, v=ids.postal_id(F.lit(cc), F.lit(code)))
    value = None
    if back:
        value = S.ZIP_COUNTRIES.index(cc) << 48
        rest = 0
        for c in code.replace(" CEDEX ", "CE").replace(" CEDEX", "CE") if cc == "FR" else code:
            rest = rest * 38 + S.ZIP_ALPHABET.index(c)
        value += rest
    assert r["v"] == value
    got = one(spark, p=ids.postal_parts(F.lit(value).cast("bigint")))["p"]
    assert (got and got["code"]) == back


def test_cells():
    rng = np.random.default_rng(1)
    lat, lng = np.degrees(np.arcsin(rng.uniform(-1, 1, 2000))), rng.uniform(-180, 180, 2000)
    leaf = geo.cell_ids(lat, lng)
    for level in (0, 4, 8, 12, 20):
        low = 1 << (2 * (30 - level))
        assert (geo.cell_ids(lat, lng, level) == ((leaf & -low) | low)).all()
        assert {geo.cell_level(int(c)) for c in geo.cell_ids(lat, lng, level)} == {level}
    assert len(np.unique(leaf)) == 2000
    # neighbours along the curve are near: cells of one parent lie within its width
    near = geo.cell_ids(lat + 1e-7, lng, 12) == geo.cell_ids(lat, lng, 12)
    assert near.mean() > 0.99
    # published ids of known places
    assert hex(int(geo.cell_ids(np.array([0.0]), np.array([0.0]))[0]) & (1 << 64) - 1) == "0x1000000000000001"


def test_geometry_codec_and_predicates():
    outer, hole = np.array([[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], float), np.array([[4, 4], [6, 4], [6, 6], [4, 6], [4, 4]], float)
    for polygons in ([[outer, hole]], [[outer, hole], [hole + 20]]):
        again = geo.read_wkb(geo.write_wkb(polygons))
        assert all((a == b).all() for p, q in zip(polygons, again) for a, b in zip(p, q))
    assert geo.contains([[outer, hole]], [5, 1, 11], [5, 1, 1]).tolist() == [False, True, False]
    assert geo.area(geo.clip_box(outer, 5, 5, 20, 20)) == 25 and len(geo.clip_box(outer, 20, 20, 30, 30)) == 0
    assert len(geo.simplify(np.array([[0, 0], [1, 0.00001], [2, 0], [3, 1]], float))) == 3


def test_distance(spark):
    r = one(spark, a=geo.distance_meters(F.lit(40.7), F.lit(-74.0), F.lit(48.85), F.lit(2.35)), z=geo.distance_meters(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0)), w=geo.in_bounds(F.lit(0.0), F.lit(179.0), F.lit(-1.0), F.lit(170.0), F.lit(1.0), F.lit(-170.0)), b=geo.bucket(F.lit(-0.2)))
    assert abs(r["a"] - 5_840_000) < 15_000 and r["z"] == 0 and r["w"] and r["b"] == -1


def test_classes_and_paths(spark):
    r = one(spark, a=enrich.classify(F.lit("P"), F.lit("PPLX")), b=enrich.classify(F.lit("S"), F.lit("AIRP")), c=enrich.classify(F.lit("A"), F.lit("ADM4")), d=enrich.should_index(F.lit("P"), F.lit("PPLQ"), F.lit("x"), F.lit("US")), p=enrich.admin_path(F.lit("US"), [F.lit("NY"), F.lit("061")], F.lit(2)), q=enrich.admin_parents(F.lit("US"), [F.lit("00"), F.lit("061")], F.lit(2)))
    assert (r["a"], r["b"], r["c"], r["d"], r["p"], r["q"]) == (S.SUBURB, S.POI, S.ADMIN3, False, "US.NY.061", ["US"])


def test_name_edits(spark):
    df = spark.createDataFrame([([("A", "en", S.PREFERRED), ("B", "en", 0)],)], "n array<struct<name: string, lang: string, flags: int>>")
    edit = lambda k, n, lang, f: [tuple(x) for x in df.select(enrich.edit_names(F.col("n"), F.lit(k), F.lit(n), F.lit(lang), F.lit(f)).alias("x")).collect()[0]["x"]]
    assert edit("Add", "C", "en", S.PREFERRED) == [("A", "en", 0), ("B", "en", 0), ("C", "en", S.PREFERRED)]
    assert edit("Remove", "A", "*", 0) == [("B", "en", 0)]
    assert edit("Modify", "B", "en", S.PREFERRED) == [("A", "en", 0), ("B", "en", S.PREFERRED)]


def test_slugs_go_to_the_better_place(spark):
    c = [(1, 0, "a", 5), (1, 1, "a-x", 5), (2, 0, "a", 9), (2, 1, "a-y", 9), (3, 0, "a-x", 1), (3, 1, "a-x-3", 1)]
    got = dict(map(tuple, indexes.assign_slugs(spark.createDataFrame(c, "fid bigint, option int, slug string, score bigint")).collect()))
    assert got == {2: "a", 1: "a-x", 3: "a-x-3"}


def test_short_prefixes(spark):
    rows = spark.createDataFrame([("ab", 1, 5), ("abcdef", 2, 9), ("abc", 3, 1)], "name string, fid bigint, score bigint")
    q = spark.createDataFrame([(1, "ab"), (2, "abc"), (3, "")], "qid bigint, prefix string")
    got = {(r["qid"], r["fid"]) for r in indexes.prefix_lookup(q, rows).collect()}
    assert got == {(1, 1), (1, 3), (2, 2), (2, 3)}


def test_slugs_go_on_until_all_have_one(spark):
    """More places than rounds of old, all with the same few options; known slugs stay."""
    c = [(k, o, s, 1000 - k) for k in range(30) for o, s in enumerate(["a", "a-b"])]
    df = spark.createDataFrame(c, "fid bigint, option int, slug string, score bigint")
    got = dict(map(tuple, indexes.assign_slugs(df).collect()))
    assert len(got) == 30 and len(set(got.values())) == 30 and got[0] == "a" and got[1] == "a-b" and got[2] == "a-b-2" and got[29] == "a-b-29"
    kept = dict(map(tuple, indexes.assign_slugs(df, spark.createDataFrame([("a", 7), ("old", 8), ("a-b", 99)], "slug string, fid bigint")).collect()))
    assert kept[7] == "a" and kept[8] == "old" and kept[99] == "a-b" and len(kept) == 31 and len(set(kept.values())) == 31 and kept[0] == "a-b-2"
    f = spark.createDataFrame([(1, 0, 0, False, S.TOWN), (2, 5, 0, False, S.TOWN), (3, 0, 1, False, S.POI), (4, 0, 0, True, S.POI), (5, 0, 0, False, S.ADMIN2)], "fid bigint, population bigint, boost bigint, has_poly boolean, woe int")
    assert {r["fid"] for r in indexes.slug_eligible(f).collect()} == {2, 3, 4, 5}


def test_edits_of_all_fields(spark):
    from atlasweave.functions.geo import read_wkb, write_text

    schema = "fid bigint, cc string, woe int, population bigint, parents array<bigint>, urls array<string>, box struct<south:double,north:double>, wkb binary, has_poly boolean, source string, slug string"
    f = spark.createDataFrame([(1, "US", 7, 5, [1, 2], None, (0.0, 1.0), None, False, "x", None), (2, "US", 7, 5, [1, 2], ["a"], None, b"w", True, "x", "s"), (3, "US", 7, 5, [1, 2], ["a"], None, b"w", True, "x", "s")], schema)
    square = "POLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))"
    e = spark.createDataFrame(
        [
            (1, 1, "Modify", "FR", None, [("Add", 9), ("Remove", 1)], [("Add", "u")], (None, 5.0), square, "new"), (1, 2, "Modify", None, 8, [("Add", 2)], None, None, None, None), (1, 3, "NoOp", "XX", 99, None, None, None, "", None),
            (2, 1, "Modify", None, None, None, [("Remove", "a")], (3.0, None), "", None), (3, 1, "Modify", "DE", None, None, None, None, "POLYGON ((bad", None),
        ],
        "fid bigint, seq bigint, kind string, cc string, woe int, parents_edits array<struct<kind:string,value:bigint>>, urls_edits array<struct<kind:string,value:string>>, box struct<south:double,north:double>, geometry string, slug string",
    )
    got = {r["fid"]: r for r in enrich.apply_edits(f, e).collect()}
    assert tuple(got[1])[1:7] == ("FR", 8, 5, [9, 2], ["u"], (0.0, 5.0)) and got[1]["has_poly"] and got[1]["source"] == "index-build-override" and got[1]["slug"] == "new"
    assert write_text(read_wkb(bytes(got[1]["wkb"]))) == square
    assert tuple(got[2])[3:8] == (5, [1, 2], [], (3.0, None), None) and got[2]["has_poly"] is False and got[2]["slug"] == "s"
    assert got[3]["cc"] == "DE" and bytes(got[3]["wkb"]) == b"w" and got[3]["has_poly"]
    assert enrich.apply_edits(f, e.limit(0)).count() == 3


def test_geometry_text():
    for text in ("POLYGON ((0 0, 1 0, 1 1, 0 0), (0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.1))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"):
        assert geo.write_text(geo.read_text(text)) == text
    assert geo.read_text("point(3 -4e1)")[0][0].tolist() == [[3, -40]] and len(geo.read_text("LINESTRING (0 0, 1 1, 2 2)")[0][0]) == 3
    assert geo.read_text('{"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}')[0][0].shape == (4, 2)
    assert geo.read_text('{"type": "Point", "coordinates": [3, 4, 5]}')[0][0].tolist() == [[3, 4]]
    for bad in ("", None, "POLYGON", "POLYGON ((0 0, 1", "CIRCLE (0 0)", "{}", '{"type": "Polygon"}', "POLYGON ((a b, c d))"):
        assert geo.read_text(bad) == []


def test_boxes_meet(spark):
    b = lambda s, w, n, e: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("south", "west", "north", "east"), (s, w, n, e))))
    r = one(spark, a=geo.boxes_meet(b(0, 0, 2, 2), b(1, 1, 3, 3)), b=geo.boxes_meet(b(0, 0, 2, 2), b(1, 3, 3, 4)), c=geo.boxes_meet(b(0, 170, 2, -170), b(1, 175, 3, 176)), d=geo.boxes_meet(b(0, 175, 2, 176), b(1, 170, 3, -170)), e=geo.boxes_meet(b(0, 0, 2, 2), b(3, 0, 4, 2)), m=geo.middle(b(0, 170, 2, -160)), w=geo.box_wkt(b(0, 1, 2, 3)))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == (True, False, True, True, False) and (r["m"]["lat"], r["m"]["lng"]) == (1, -175)
    assert geo.read_text(r["w"])[0][0][0].tolist() == [1, 0]


def test_letters_and_languages(spark):
    r = one(spark, a=names.transliterate(F.lit("Москва, Щёлково")), b=names.transliterate(F.lit("Αθηνα Theta")), c=names.language_of(F.lit("plain")), d=names.language_of(F.lit("Kœln")))
    assert (r["a"], r["b"], r["c"], r["d"]) == ("Moskva, Shchyolkovo", "Athina Theta", "en", "unk")
