"""Import files, polygons, reverse geocoding, sinks and the hotfix stream."""

import base64
import json
import struct

import numpy as np
import pytest

from atlasweave import schema as S
from atlasweave.functions import geo
from atlasweave.operators import polygons
from atlasweave.plans import reverse
from atlasweave.sources import readers, sinks
from atlasweave.streaming import hotfix

NS = 1 << 56


def put(tmp_path, name, *lines):
    (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
    return [str(tmp_path / name)]


def place(i, name, cls, code, cc="US", extra=""):
    return "\t".join([str(i), name, name, "", "40.5", "-73.5", cls, code, cc, "", "NY", "061", "", "", "1000", "", "", "tz", "2020"] + ([extra] if extra else []))


def test_gazetteer(spark, tmp_path):
    p = put(tmp_path, "all.txt", place(1, "Town", "P", "PPL", extra="boost;7"), place(2, "Old", "P", "PPLQ"), place(3, "Bldg", "S", "BLDG"), place(4, "State", "A", "ADM1"), "short\tline", place(5, "No", "P", "PPL").replace("40.5", "x"), place(6, "Kin", "P", "PPL", extra="parents;4,5"))
    rows = {r["fid"] - NS: r for r in readers.gazetteer(spark, [*p, str(tmp_path / "missing.txt")]).collect()}
    assert set(rows) == {1, 4, 6} and rows[1]["boost"] == 7 and rows[4]["woe"] == S.ADMIN1 and rows[6]["parents"] == [NS + 4, NS + 5]
    names = {(r["fid"] - NS, r["name"], r["lang"], r["flags"]) for r in readers.embedded_names(readers.gazetteer(spark, p)).collect()}
    assert (4, "NY", "abbr", S.ABBREVIATION) in names and (1, "Town", "en", S.PREFERRED) in names
    assert readers.gazetteer(spark, [str(tmp_path / "none")]).count() == 0
    assert [tuple(r)[:2] for r in readers.extract_admin(readers.lines(spark, put(tmp_path, "adm.txt", "\t".join(["9", "X", "X", "", "1", "2", "A", "ADM2", "US", "", "NY", "061", "", "", "0", "", "", "", ""])))).collect()] == [("US.NY.061", "X")]


def test_small_files(spark, tmp_path):
    assert [tuple(r) for r in readers.boosts(spark, put(tmp_path, "b.txt", "# note", "1|5", "1|6", "geonameid:2|1", "x|y")).orderBy("fid").collect()] == [(NS + 1, 11), (NS + 2, 1)]
    assert [tuple(r) for r in readers.hierarchy(spark, put(tmp_path, "h.txt", "1\t2\tADM", "1\t3\tother")).collect()] == [(NS + 2, NS + 1)]
    assert readers.boxes(spark, put(tmp_path, "bb.txt", "1 -1 -2 1 2", "2\t1\t2\t3", "3\ta\t1\t1\t1")).count() == 1
    assert [tuple(r) for r in readers.alternate_names(spark, put(tmp_path, "a.txt", "9\t1\ten\tName\t1\t\t1", "9\t1\tpost\t123\t\t\t\t")).collect()] == [(NS + 1, "Name", "en", S.PREFERRED | S.COLLOQUIAL)]
    assert readers.postal_codes(spark, put(tmp_path, "z.txt", "US\t10003\tNY\ta\tb\tc\td\te\tf\t40.7\t-74.0", "QQ\t1\ta\ta\ta\ta\ta\ta\ta\t1\t1\t1")).select("name", "population").collect() == [("10003", 1000)]
    g = readers.getty(spark, put(tmp_path, "g.json", json.dumps({"geometry": {"coordinates": [-118.0, 65.0], "type": "Point"}, "properties": {"hierarchy": ["tgn:1000296", "bad"], "id": 77, "name:en": "North"}}), "not json")).collect()
    assert len(g) == 1 and (g[0]["lat"], g[0]["lng"], g[0]["parents"]) == (65.0, -118.0, [(6 << 56) + 1000296]) and g[0]["names"][0]["name"] == "North"
    e = {r["kind"] + ":" + str(r["name"]): r for r in readers.edits(spark, put(tmp_path, "i", "5"), put(tmp_path, "m", "5|1.5,2.5", "bad"), put(tmp_path, "d", "5|Gone"), put(tmp_path, "t", "5 en|Neu|PREFERRED,SHORT_NAME")).collect()}
    assert e["Modify:None"]["lat"] == 1.5 and e["Modify:Neu"]["flags"] == 129 and e["Modify:Gone"]["lang"] == "*" and "Remove:None" in e
    assert readers.rules(spark, put(tmp_path, "r", "Mount\\b|Mt,Mtn"), put(tmp_path, "s", "US,CA|Saint|St"), put(tmp_path, "x", "Town"))["shortens"] == [("US", "Saint", "St"), ("CA", "Saint", "St")]
    assert {r["key"]: r["values"] for r in readers.helper_table(spark, put(tmp_path, "k1", "a|1,2", "b|9") + put(tmp_path, "k2", "a|3")).collect()} == {"a": ["3", "1", "2"], "b": ["9"]}


SQUARE = np.array([[0, 0], [0.1, 0], [0.1, 0.1], [0, 0.1], [0, 0]], float)


@pytest.fixture()
def places(spark):
    rows = [(NS + 1, "US", S.TOWN, 0.05, 0.05, 10, 0, [], [], False, True), (NS + 2, "US", S.TOWN, 0.06, 0.06, 5, 0, [], [], False, True), (NS + 3, "US", S.COUNTRY, 0.05, 0.05, 5, 0, [], [], False, True)]
    return spark.createDataFrame(rows, S.FEATURES)


def test_polygon_matching(spark, tmp_path, places):
    b = base64.urlsafe_b64encode(geo.write_wkb([[SQUARE]])).decode()
    far = base64.urlsafe_b64encode(geo.write_wkb([[SQUARE + 5]])).decode()
    p = readers.flattened_polygons(spark, put(tmp_path, "p.txt", f"7\tsrc\t\ten:Spring Town\tADMIN3|TOWN\t{b}", f"8\tsrc\t{NS + 2}\t\t\t{far}", f"9\tsrc\t\ten:Lonely\tTOWN\t{far}"))
    names = spark.createDataFrame([(NS + 1, "Spring-Town", "en", 1), (NS + 2, "Other", "en", 1)], S.NAMES)
    m = polygons.match_polygons(p, places, names)
    assert [tuple(r) for r in m.collect()] == [(NS + 1, 7)]
    got = {r["fid"] - NS: r for r in polygons.attach_polygons(places, p, m).collect()}
    assert got[1]["has_poly"] and got[1]["wkb"] is not None and not got[2]["has_poly"] and got[2]["wkb"] is None and len(got) == 3
    new = polygons.features_of_unmatched(p, m).collect()
    assert [(r["name"], r["woe"], round(r["lat"], 3)) for r in new] == [("Lonely", S.TOWN, 5.05)]


def test_reverse(spark, places):
    shapes = spark.createDataFrame([(NS + 1, geo.write_wkb([[SQUARE]])), (NS + 3, geo.write_wkb([[SQUARE * 3 - 0.1]])), (NS + 2, b"bad")], "fid bigint, wkb binary")
    index = reverse.cell_index(shapes)
    q = spark.createDataFrame([(1, 0.05, 0.05, None), (2, 0.15, 0.15, None), (3, 5.0, 5.0, None), (4, 0.05, 0.101, 500.0), (5, 95.0, 0.0, None), (6, None, 0.0, None)], "qid bigint, lat double, lng double, radius double")
    rows = [(r["qid"], r["rank"], r["fid"] - NS) for r in reverse.reverse_geocode(q, index, places).orderBy("qid", "rank").collect()]
    assert rows == [(1, 1, 1), (1, 2, 3), (2, 1, 3), (4, 1, 1), (4, 2, 3)]
    share = {r["fid"] - NS: r["request_share"] for r in reverse.reverse_geocode(q.where("qid = 4"), index, places).collect()}
    assert 30 < share[1] < 50 and share[3] == pytest.approx(100, abs=0.1)
    fixed = {r["fid"] - NS: r["parents"] for r in reverse.repair_parents(places, index).collect()}
    assert fixed == {1: [NS + 3], 2: [NS + 1, NS + 3], 3: []}
    assert all(len(r["cells"]) <= 50 for r in reverse.coverings(shapes.where(f"fid <> {NS + 2}"), (4, 12)).collect())


def test_shapefile(spark, tmp_path):
    from atlasweave.sources.shapefile import Shapefile

    ring = SQUARE[::-1]  # clockwise
    body = struct.pack("<i4d2i", 5, 0, 0, 0.1, 0.1, 1, len(ring)) + struct.pack("<i", 0) + ring.astype("<f8").tobytes()
    (tmp_path / "a.shp").write_bytes(bytes(100) + b"".join(struct.pack(">ii", i + 1, len(body) // 2) + body for i in range(2)))
    (tmp_path / "a.shx").write_bytes(bytes(100) + b"".join(struct.pack(">ii", (100 + i * (8 + len(body))) // 2, len(body) // 2) for i in range(2)))
    field = b"NAME".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14)
    (tmp_path / "a.dbf").write_bytes(b"\x03" + bytes(3) + struct.pack("<iHH", 2, 65, 7) + bytes(20) + field + b"\r" + b" " + "Köl".encode().ljust(6) + b" " + b"two   ")
    spark.dataSource.register(Shapefile)
    rows = spark.read.format("shapefile").option("path", str(tmp_path / "a.shp")).load().collect()
    assert [r["attributes"]["NAME"] for r in rows] == ["Köl", "two"] and (geo.read_wkb(bytes(rows[0]["wkb"]))[0][0] == ring).all()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", NS), ("a", 2)], "key string, fid bigint")
    sinks.write_index(df, f"{tmp_path}/i", "key", meta={"levels": 3})
    sinks.write_index(df.limit(0), f"{tmp_path}/i", "key")
    assert [r["key"] for r in spark.read.parquet(f"{tmp_path}/i").orderBy("key").collect()] == ["a", "b"]
    assert json.loads(sinks.to_json(df.limit(1), ["fid"]).collect()[0]["json"])["fid"] == str(NS)
    assert sinks.to_json(df.limit(1), ["fid"], "f").collect()[0]["json"].startswith("f({")


def test_hotfix_stream(spark, tmp_path, places):
    (tmp_path / "in").mkdir()
    seen = {}
    run = lambda: hotfix.start(hotfix.edit_stream(spark, str(tmp_path / "in"), 1), places, lambda df, n: seen.update({n: {r["fid"] - NS: r["population"] for r in df.collect()}}), str(tmp_path / "state"), True).awaitTermination()
    (tmp_path / "in/a.json").write_text(json.dumps({"fid": NS + 1, "seq": 0, "kind": "Modify", "population": 99}))
    run()
    (tmp_path / "in/b.json").write_text(json.dumps({"fid": NS + 2, "seq": 0, "kind": "Remove"}) + "\n" + json.dumps({"fid": NS + 9, "seq": 1, "kind": "Add", "population": 4, "cc": "FR"}))
    run()
    (tmp_path / "in/c.json").write_text(json.dumps({"fid": NS + 2, "seq": 0, "kind": "Add", "population": 7, "cc": "FR"}) + "\n" + json.dumps({"fid": NS + 9, "seq": 1, "kind": "Modify", "population": 6}) + "\n" + json.dumps({"fid": NS + 1, "seq": 2, "kind": "Remove"}))
    run()
    assert seen == {0: {1: 99, 2: 5, 3: 5}, 1: {1: 99, 3: 5, 9: 4}, 2: {2: 7, 3: 5, 9: 6}}
