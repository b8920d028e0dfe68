"""From files to answers."""

import base64

import numpy as np
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo
from atlasweave.operators.expand import expand_names, slug_candidates
from atlasweave.plans.build import build
from atlasweave.plans.geocode import geocode
from atlasweave.plans.reverse import reverse_geocode

NS = 1 << 56


def put(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return [str(tmp_path / name)]


def place(i, name, lat, lng, cls, code, adm="NY", population=0):
    return "\t".join([str(i), name, name, "", str(lat), str(lng), cls, code, "US", "", adm, "", "", "", str(population), "", "", "tz", "2020"])


def test_build_and_ask(spark, tmp_path):
    square = np.array([[-73.9, 40.7], [-73.8, 40.7], [-73.8, 40.8], [-73.9, 40.8], [-73.9, 40.7]])
    files = {
        "places": put(tmp_path, "p", place(1, "United States", 40, -100, "A", "PCLI", ""), place(2, "New York", 43, -75, "A", "ADM1"), place(3, "Rego Park", 40.72, -73.86, "P", "PPL", population=500012), place(4, "Gone", 1, 1, "P", "PPL"), place(5, "Mount Näme County", 40.75, -73.85, "P", "PPL", population=9)),
        "admin": put(tmp_path, "a", "US.NY\tNew York\tNew York\t2"), "countries": put(tmp_path, "c", "\t".join(["US", "USA", "840", "US", "United States"] + [""] * 10 + ["en-US,es", "1", "", ""])),
        "names": put(tmp_path, "n", "1\t3\tes\tParque Rego\t1"), "boosts": put(tmp_path, "b", "3|5"), "ignores": put(tmp_path, "i", "4"), "transforms": put(tmp_path, "t", "3 en|Regoville|ALT_NAME"), "deletes_of_names": put(tmp_path, "d", "3|Parque Rego"),
        "rewrites": put(tmp_path, "r", "Mount\\b|Mt"), "deletes": put(tmp_path, "x", "County"), "polygons": put(tmp_path, "s", f"1\tsrc\t{NS + 3}\t\t\t{base64.urlsafe_b64encode(geo.write_wkb([[square]])).decode()}"),
    }
    store, index = build(spark, files)
    rows = {r["fid"] - NS: r for r in store.features.collect()}
    assert set(rows) == {1, 2, 3, 5} and rows[3]["boost"] == 5 and rows[3]["has_poly"] and set(rows[3]["parents"]) == {NS + 1, NS + 2}
    names = {(r["fid"] - NS, r["name"]) for r in store.names.collect()}
    assert {(3, "Regoville"), (5, "Mt Näme"), (5, "Mount Name County"), (5, "Mount Näme")} <= names and (3, "Parque Rego") not in names
    ask = spark.createDataFrame([(1, "pizza regoville new york", None, "en", None, None, None, None), (2, "mt name", None, "en", None, None, None, None)], S.REQUESTS)
    got = {r["qid"]: r for r in geocode(ask, store).collect()}
    assert got[1]["fid"] == NS + 3 and got[1]["what"] == "pizza" and set(got) == {1}
    points = spark.createDataFrame([(1, 40.75, -73.85, None)], "qid bigint, lat double, lng double, radius double")
    assert [r["fid"] - NS for r in reverse_geocode(points, index, store.features).collect()] == [3]


def test_expansion(spark):
    f = spark.createDataFrame([(1, "JP", S.TOWN), (2, "PH", S.ADMIN1), (3, "US", S.TOWN)], "fid bigint, cc string, woe int")
    n = spark.createDataFrame([(1, "Katsuura Gun", "en", 1), (1, "Katsuura-gun", "en", 0), (2, "Province of Cebu", "en", 1), (3, "Zip", "post", 0), (3, "Mount Fort", "en", 1), (3, "Mt Fort", "en", S.ALIAS), (3, "MF", "abbr", 0)], S.NAMES)
    rules = {"rewrites": [(r"Mount\b", ["Mt"])], "shortens": [("*", "Province of", "")], "deletes": ["Fort"]}
    got = {(r["fid"], r["name"]): r["flags"] for r in expand_names(n, f, rules).collect()}
    assert (1, "Katsuura-gun") not in got and got[2, "Cebu"] == S.PREFERRED | S.SHORT_NAME and (3, "Zip") not in got
    assert got[3, "Mt Fort"] == S.PREFERRED | S.ALIAS and got[3, "Mount"] & S.ALIAS and got[3, "MF"] == S.ABBREVIATION


def test_slug_templates(spark):
    kin = [(S.ADMIN1, "New York"), (S.COUNTRY, "United States")]
    df = spark.createDataFrame([(1, "US", S.TOWN, "Régo Park", kin), (2, "FR", S.COUNTRY, "France", []), (3, "FR", S.ADMIN1, "Île", [(S.COUNTRY, "France")])], "fid bigint, cc string, woe int, name string, kin array<struct<woe: int, name: string>>")
    got = {(r["fid"], r["slug"]): r["option"] for r in slug_candidates(df).collect()}
    assert {s for f, s in got if f == 1} == {"rego-park-new-york", "rego-park-new-york-united-states", "rego-park-united-states"}
    assert {s for f, s in got if f == 2} == {"france"} and {s for f, s in got if f == 3} == {"france/ile", "ile-france"}
    assert got[1, "rego-park-new-york"] < got[1, "rego-park-united-states"] and df.select(F.size("kin")).count() == 3


def test_build_reads_every_kind_of_file(spark, tmp_path):
    """Boxes, attributes, concordances, known slugs, and what places carry themselves; then all lookup tables."""
    from atlasweave.plans.build import write_indexes

    square = geo.write_text([[np.array([[-73.9, 40.7], [-73.8, 40.7], [-73.8, 40.8], [-73.9, 40.8], [-73.9, 40.7]])]])
    files = {
        "places": put(tmp_path, "p", place(1, "United States", 40, -100, "A", "PCLI", ""), place(2, "New York", 43, -75, "A", "ADM1"), place(3, "Rego Park", 40.72, -73.86, "P", "PPL", population=500012) + f"\tgeometry;{square}\tbbox;-73.9,40.7,-73.8,40.8", place(5, "Other Town", 41, -75, "P", "PPL", population=9)),
        "admin": put(tmp_path, "a", "US.NY\tNew York\tNew York\t2"), "countries": put(tmp_path, "c", "\t".join(["US", "USA", "840", "US", "United States of America"] + [""] * 10 + ["en-US,es", "1", "", ""])),
        "names": put(tmp_path, "n", "1\t3\ten\tRegoville\t1", "2\t1\tfr\tÉtats-Unis"), "boxes": put(tmp_path, "bb", "5\t-75.1\t40.9\t-74.9\t41.1"), "attributes": put(tmp_path, "at", "3\t0\t1\t1\t1\t1"), "concordances": put(tmp_path, "co", "3|woeid:77"),
        "slugs": put(tmp_path, "sl", "old-town\t5\t1\tfalse", "gone\t3\t1\ttrue"),
    }
    store, index = build(spark, files)
    rows = {r["fid"] - NS: r for r in store.features.collect()}
    assert rows[3]["has_poly"] and rows[3]["world_city"] and rows[3]["box"]["south"] == 40.7 and rows[5]["box"]["west"] == -75.1 and not rows[5]["world_city"] and rows[1]["box"] is None
    assert rows[3]["other_ids"] == ["woeid:77"] and rows[5]["other_ids"] == []
    flags = {(r["fid"] - NS, r["name"]): r["flags"] for r in store.names.collect()}
    assert not flags[3, "Rego Park"] & S.PREFERRED and flags[3, "Regoville"] & S.PREFERRED and flags[1, "United States of America"] & S.COLLOQUIAL and flags[1, "United States"] & S.PREFERRED
    slugs = {r["fid"] - NS: r["slug"] for r in store.slugs.collect()}
    assert slugs[5] == "old-town" and slugs[3].startswith("regoville-") and set(slugs) == {1, 2, 3, 5}
    path = str(tmp_path / "indexes")
    for name in write_indexes(store.written(), index, path):
        assert spark.read.parquet(f"{path}/{name}").count() > 0, name
    keys = {r["key"]: r["fid"] - NS for r in spark.read.parquet(f"{path}/ids").collect()}
    assert keys["old-town"] == 5 and keys[str((4 << 56) + 77)] == 3
    inside = spark.read.parquet(f"{path}/interiors").collect()
    assert [r["fid"] - NS for r in inside] == [3] and len(inside[0]["cells"]) > 10


def test_index_deltas(spark):
    from atlasweave.operators import indexes
    from atlasweave.plans.geocode import Store
    from atlasweave.streaming.hotfix import index_deltas

    f = spark.createDataFrame([(NS + k, "US", S.TOWN, 5.0, 6.0, 100 - k, 0, [], [], False, True) for k in range(6)], S.FEATURES)
    n = spark.createDataFrame([(NS + k, name, "en", S.PREFERRED, 0) for k, name in enumerate(["Alpha", "Alphabet", "Beta", "Beta", "Gamma", "Delta"])], S.NAMES + ", pos int")
    store = Store.of(f, n)
    changed = spark.createDataFrame([(NS + 2, "US", S.TOWN, 5.0, 6.0, 1, 0, [], [], False, True), (NS + 9, "US", S.TOWN, 5.0, 6.0, 500, 0, [], [], False, True)], S.FEATURES)
    deleted = spark.createDataFrame([(NS + 4,)], "fid bigint")
    names = spark.createDataFrame([(NS + 2, "Alps", "en", S.PREFERRED, 0), (NS + 9, "Alpha", "en", S.PREFERRED, 0)], S.NAMES + ", pos int")
    after = store.with_edits(changed, deleted, names)
    whole = {"names": indexes.name_index, "prefixes": indexes.prefix_index}
    for name, (gone, come) in index_deltas(store, after, changed, deleted).items():
        rows = lambda df: {tuple(map(str, r)) for r in df.collect()}
        before, now = rows(whole[name](store.names, store.features)), rows(whole[name](after.names, after.features))
        assert (before - rows(gone)) | rows(come) == now and before != now
        assert not any("delt" in x for r in rows(come) for x in r)
