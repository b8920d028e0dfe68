"""Readers of gazetteer import files. Every reader gives an empty table with its schema if none of its paths exists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions.ids import feature_id, parse_id, postal_id
from atlasweave.operators.enrich import classify, should_index


def lines(spark: SparkSession, paths: list[str], comments: bool = True, glob: str | None = None, recursive: bool = False) -> DataFrame:
    """(value, file, line) of the text files that exist, without lines that begin with #; the order within a file is kept in line."""
    from py4j.protocol import Py4JJavaError

    hadoop = spark._jsc.hadoopConfiguration()
    jvm = spark._jvm.org.apache.hadoop.fs
    found = []
    for p in paths:
        try:
            at = jvm.Path(p)
            if at.getFileSystem(hadoop).exists(at):
                found.append(p)
        except Py4JJavaError:
            continue
    if not found:
        return spark.createDataFrame([], "value string, file string, line bigint")
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    out = reader.text(found).select("value", F.col("_metadata.file_path").alias("file"), F.floor(F.col("_metadata.file_block_start") / 4096).alias("block"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    # blocks of a file are over 4 KB apart and its rows are in order within a task, so this is the order of lines
    out = out.select("value", "file", (F.shiftleft("block", 33) + F.col("row")).alias("line"))
    return out.where(~F.col("value").startswith("#")) if comments else out


def _cut(df: DataFrame, pattern: str) -> DataFrame:
    return df.withColumn("p", F.split("value", pattern))


def _p(i: int) -> Column:
    return F.get("p", F.lit(i))


def _id(c: Column) -> Column:
    return parse_id(F.trim(c), "geonameid")


def gazetteer(spark: SparkSession, paths: list[str], buildings: bool = False) -> DataFrame:
    """Administrative and populated places: 19 tab-separated columns and extras ``key;value``. Rows that can't be placed or
    aren't wanted give no feature: too few columns, no name or position, excluded codes."""
    d = _cut(lines(spark, paths, comments=False), "\t").where(F.size("p") >= 19)
    extra = F.map_from_entries(F.transform(F.filter(F.slice("p", F.lit(20), F.size("p")), lambda x: x.contains(";")), lambda x: F.struct(F.substring_index(x, ";", 1).alias("k"), F.substring(x, F.instr(x, ";") + 1, F.length(x)).alias("v"))))
    d = d.withColumn("x", extra)
    cc = F.when(_p(7).contains("STLMT"), "IL").when(_p(8) == "", "XX").otherwise(_p(8))
    d = d.select(
        feature_id(1, _p(0).try_cast("bigint")).alias("fid"), _p(1).alias("name"), _p(2).alias("ascii"), _p(4).try_cast("double").alias("lat"), _p(5).try_cast("double").alias("lng"), _p(6).alias("cls"), _p(7).alias("code"), cc.alias("cc"),
        F.slice("p", 11, 4).alias("admin"), F.coalesce(_p(14).try_cast("bigint"), F.lit(0).cast("bigint")).alias("population"), _p(17).alias("timezone"), F.coalesce(F.col("x")["boost"].try_cast("bigint"), F.lit(0).cast("bigint")).alias("boost"),
        F.coalesce(F.lower(F.col("x")["canGeocode"]) != "false", F.lit(True)).alias("can_geocode"), F.filter(F.transform(F.split(F.coalesce(F.col("x")["parents"], F.lit("")), ","), lambda i: _id(i)), lambda i: i.isNotNull()).alias("parents"), F.col("x")["bbox"].alias("bbox"), F.col("x")["geometry"].alias("geometry"),
    ).where("fid IS NOT NULL AND name <> '' AND lat IS NOT NULL AND lng IS NOT NULL")
    return d.where(should_index(F.col("cls"), F.col("code"), F.col("name"), F.col("cc"), buildings)).withColumn("woe", classify(F.col("cls"), F.col("code")))


def embedded_names(features: DataFrame) -> DataFrame:
    """(fid, name, lang, flags) that gazetteer rows carry themselves."""
    n = lambda name, lang, flags: F.struct(name.alias("name"), F.lit(lang).alias("lang"), F.lit(flags).alias("flags"))
    level = F.when(F.col("woe") == S.ADMIN1, 1).when(F.col("woe") == S.ADMIN2, 2).when(F.col("woe") == S.ADMIN3, 3).otherwise(0)
    code = F.get("admin", level - 1)
    made = F.array(
        n(F.col("name"), "en", S.PREFERRED), F.when((F.col("ascii") != "") & (F.col("ascii") != F.col("name")), n(F.col("ascii"), "en", S.DEACCENT)), F.when(F.col("woe") == S.COUNTRY, n(F.col("cc"), "abbr", S.ABBREVIATION)),
        F.when((level > 0) & (code != "") & ~code.rlike("^[0-9]+$"), n(code, "abbr", S.ABBREVIATION)), F.when((level > 0) & code.rlike("^[0-9]+$"), n(code, "", S.NEVER_DISPLAY)),
    )
    return features.select("fid", F.explode(F.filter(made, lambda x: x.isNotNull())).alias("x")).select("fid", "x.*")


def postal_codes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Postal codes: 12 tab-separated columns (11 are padded); codes that can't be packed into an id give no row."""
    d = _cut(lines(spark, paths, comments=False), "\t").where(F.size("p").isin(11, 12))
    return d.select(feature_id(2, postal_id(_p(0), _p(1))).alias("fid"), _p(1).alias("name"), _p(9).try_cast("double").alias("lat"), _p(10).try_cast("double").alias("lng"), _p(0).alias("cc"), F.lit(S.POSTAL_CODE).alias("woe"), F.when(_p(0) == "US", 1000).otherwise(0).cast("bigint").alias("population")).where("fid IS NOT NULL AND lat IS NOT NULL AND lng IS NOT NULL")


def getty(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One GeoJSON feature a line: fid, centroid of a point, names by language, ancestor ids; other lines give no row."""
    schema = "geometry struct<type: string, coordinates: string>, properties map<string, string>"
    d = lines(spark, paths).select(F.from_json("value", schema).alias("j")).where("j.properties['id'] IS NOT NULL")
    props = F.col("j.properties")
    at = F.from_json("j.geometry.coordinates", "array<double>")
    named = F.map_filter(props, lambda k, v: k.startswith("name:"))
    kin = F.filter(F.transform(F.from_json(props["hierarchy"], "array<string>"), lambda x: parse_id(x)), lambda x: x.isNotNull())
    return d.select(feature_id(6, props["id"].try_cast("bigint")).alias("fid"), F.get(at, F.lit(1)).alias("lat"), F.get(at, F.lit(0)).alias("lng"), F.transform(F.map_entries(named), lambda e: F.struct(F.substring(e["key"], F.lit(6), F.length(e["key"])).alias("lang"), e["value"].alias("name"))).alias("names"), F.coalesce(kin, F.array().cast("array<bigint>")).alias("parents"), F.lit(S.UNKNOWN).alias("woe")).where("fid IS NOT NULL")


def boxes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, west, south, east, north by tab or space."""
    d = _cut(lines(spark, paths), "[\t ]").where(F.size("p") == 5)
    return d.select(_id(_p(0)).alias("fid"), *(_p(i).try_cast("double").alias(c) for i, c in enumerate(["west", "south", "east", "north"], 1))).where("fid IS NOT NULL AND north IS NOT NULL AND west IS NOT NULL AND south IS NOT NULL AND east IS NOT NULL")


def alternate_names(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(fid, name, lang, flags) of alternate-name files; postal names are left out."""
    d = _cut(lines(spark, paths, comments=False), "\t").where((F.size("p") >= 4) & (_p(2) != "post"))
    flags = sum((F.when(_p(4 + i) == "1", f).otherwise(0) for i, f in enumerate([S.PREFERRED, S.SHORT_NAME, S.COLLOQUIAL, S.HISTORIC])), F.lit(0))
    return d.select(_id(_p(1)).alias("fid"), _p(3).alias("name"), _p(2).alias("lang"), flags.alias("flags")).where("fid IS NOT NULL")


def relations(spark: SparkSession, paths: list[str], source: int = 0, target: int = 1, kind: str | None = None) -> DataFrame:
    """(fid, other) pairs by tab or bar; ``kind`` keeps lines with that third column (hierarchies: parent, child, ADM)."""
    d = _cut(lines(spark, paths), r"[\t|]").where(F.size("p") > max(source, target))
    if kind:
        d = d.where(_p(2) == kind)
    return d.select(_id(_p(source)).alias("fid"), _id(_p(target)).alias("other")).where("fid IS NOT NULL AND other IS NOT NULL")


def hierarchy(spark: SparkSession, paths: list[str]) -> DataFrame:
    return relations(spark, paths, 1, 0, "ADM").withColumnRenamed("other", "parent")


def boosts(spark: SparkSession, paths: list[str]) -> DataFrame:
    d = _cut(lines(spark, paths), r"[|]").where(F.size("p") == 2)
    return d.select(_id(_p(0)).alias("fid"), F.trim(_p(1)).try_cast("bigint").alias("boost")).where("fid IS NOT NULL AND boost IS NOT NULL").groupBy("fid").agg(F.sum("boost").alias("boost"))


def slugs(spark: SparkSession, paths: list[str]) -> DataFrame:
    d = _cut(lines(spark, paths), "\t").where(F.size("p") == 4)
    return d.select(_p(0).alias("slug"), _id(_p(1)).alias("fid"), _p(2).try_cast("bigint").alias("score"), (F.lower(_p(3)) == "true").alias("deprecated")).where("fid IS NOT NULL AND score IS NOT NULL")


def _flags(text: Column) -> Column:
    names = ["PREFERRED", "ABBREVIATION", "DEACCENT", "ALIAS", "LOCAL_LANG", "ALT_NAME", "COLLOQUIAL", "SHORT_NAME", "NEVER_DISPLAY", "LOW_QUALITY", "HISTORIC"]
    return F.aggregate(F.split(text, ","), F.lit(0), lambda a, x: a.bitwiseOR(F.coalesce(F.element_at(F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, 1 << i)]), x), F.lit(0))))


def edits(spark: SparkSession, ignores: list[str] = (), moves: list[str] = (), name_deletes: list[str] = (), name_transforms: list[str] = ()) -> DataFrame:
    """(fid, seq, kind, lat, lng, name_kind, name, lang, flags) of the edit files, transforms before deletes; seq orders them."""
    n = lambda t: F.lit(None).cast(t)
    cols = lambda d, fid, kind, lat, lng, nk, name, lang, flags, rank: d.select(fid.alias("fid"), F.struct(F.lit(rank).alias("rank"), "file", "line").alias("seq"), F.lit(kind).alias("kind"), lat.alias("lat"), lng.alias("lng"), nk.alias("name_kind"), name.alias("name"), lang.alias("lang"), flags.alias("flags")).where("fid IS NOT NULL")
    a = cols(lines(spark, list(ignores)), _id(F.col("value")), "Remove", n("double"), n("double"), n("string"), n("string"), n("string"), n("int"), 0)
    m = _cut(lines(spark, list(moves)), r"\|").where(F.size("p") == 2).withColumn("ll", F.split(_p(1), ",")).where(F.size("ll") == 2)
    m = cols(m, _id(_p(0)), "Modify", F.get("ll", F.lit(0)).try_cast("double"), F.get("ll", F.lit(1)).try_cast("double"), n("string"), n("string"), n("string"), n("int"), 1).where("lat IS NOT NULL AND lng IS NOT NULL")
    t = _cut(lines(spark, list(name_transforms)), "[\t ]").withColumn("r", F.split(F.array_join(F.slice("p", F.lit(2), F.size("p")), " "), r"\|")).where((F.size("p") > 1) & (F.size("r") > 1))
    flags = F.when(F.size("r") > 2, _flags(F.get("r", F.lit(2)))).otherwise(F.lit(S.PREFERRED))
    t = cols(t, _id(_p(0)), "Modify", n("double"), n("double"), F.lit("Add"), F.get("r", F.lit(1)), F.get("r", F.lit(0)), flags, 2).where("flags <> 0")
    x = _cut(lines(spark, list(name_deletes)), r"\|").where(F.size("p") == 2)
    x = cols(x, _id(_p(0)), "Modify", n("double"), n("double"), F.lit("Remove"), _p(1), F.lit("*"), F.lit(0), 3)
    return a.unionByName(m).unionByName(t).unionByName(x)


def flattened_polygons(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(polygon, source, fids, names, levels, wkb) of six-column lines; levels are lists of place types by preference."""
    d = _cut(lines(spark, paths), "\t").where(F.size("p") == 6)
    types = F.create_map(*[F.lit(v) for k, c in {"TOWN": S.TOWN, "ADMIN1": S.ADMIN1, "ADMIN2": S.ADMIN2, "ADMIN3": S.ADMIN3, "COUNTRY": S.COUNTRY, "SUBURB": S.SUBURB, "POI": S.POI, "POSTAL_CODE": S.POSTAL_CODE, "AIRPORT": S.AIRPORT, "ISLAND": S.ISLAND, "PARK": S.PARK, "CONTINENT": S.CONTINENT}.items() for v in (k, c)])
    fids = F.filter(F.transform(F.split(_p(2), ","), lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())
    named = F.filter(F.transform(F.split(_p(3), r"\|"), lambda x: F.struct(F.substring_index(x, ":", 1).alias("lang"), F.get(F.split(x, ":"), F.lit(1)).alias("name"))), lambda x: x["name"] != "")
    levels = F.filter(F.transform(F.split(_p(4), r"\|"), lambda a: F.filter(F.transform(F.split(a, ","), lambda x: F.element_at(types, x)), lambda x: x.isNotNull())), lambda a: F.size(a) > 0)
    return d.select(_p(0).try_cast("bigint").alias("polygon"), _p(1).alias("source"), fids.alias("fids"), named.alias("names"), levels.alias("levels"), F.unbase64(F.translate(_p(5), "-_", "+/")).alias("wkb")).where("polygon IS NOT NULL")


def attributes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(fid, adm0cap, worldcity, scalerank, natscale, labelrank)."""
    d = _cut(lines(spark, paths), "\t").where(F.size("p") == 6)
    return d.select(_id(_p(0)).alias("fid"), *(_p(i).try_cast("int").alias(c) for i, c in enumerate(["adm0cap", "worldcity", "scalerank", "natscale", "labelrank"], 1))).where("fid IS NOT NULL")


def countries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(cc, name, languages, fid) of a country table; variants of languages are cut off."""
    d = _cut(lines(spark, paths), "\t").where(F.size("p") >= 17)
    return d.select(_p(0).alias("cc"), _p(4).alias("name"), F.array_distinct(F.transform(F.split(_p(15), ","), lambda x: F.substring_index(x, "-", 1))).alias("languages"), feature_id(1, _p(16).try_cast("bigint")).alias("fid"))


def admin_codes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, fid) of dotted codes."""
    d = _cut(lines(spark, paths), "\t").where(F.size("p") >= 4)
    return d.select(_p(0).alias("path"), _p(1).alias("name"), feature_id(1, _p(3).try_cast("bigint")).alias("fid"))


def extract_admin(gazetteer_lines: DataFrame) -> DataFrame:
    """(path, name, ascii, id) of gazetteer lines of class A whose codes go as deep as their level."""
    d = _cut(gazetteer_lines, "\t").where((F.size("p") >= 19) & (_p(6) == "A") & _p(7).isin("ADM1", "ADM2", "ADM3", "ADM4"))
    codes = F.filter(F.slice("p", 11, 4), lambda x: x != "")
    level = F.substring(_p(7), 4, 1).cast("int")
    return d.where(F.size(codes) == level).select(F.concat_ws(".", _p(8), codes).alias("path"), _p(1).alias("name"), _p(2).alias("ascii"), _p(0).alias("id"))


def helper_table(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(key, values) of two columns by bar or tab, values by comma; of repeated keys, later files and lines come first."""
    d = _cut(lines(spark, paths), r"[|\t]").where(F.size("p") >= 2)
    order = F.create_map(*[F.lit(v) for i, p in enumerate(paths) for v in (p.rsplit("/", 1)[-1], i)]) if paths else F.create_map(F.lit(""), F.lit(0))
    d = d.withColumn("o", F.coalesce(F.element_at(order, F.element_at(F.split("file", "/"), -1)), F.lit(0)))
    return d.groupBy(_p(0).alias("key")).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("o", "line", F.split(_p(1), ",").alias("v"))), asc=False), lambda x: x["v"])).alias("values"))


def unused(table: DataFrame, used: DataFrame, key: str = "key") -> DataFrame:
    """Rows of a helper table that nothing used."""
    return table.join(used.select(key).distinct(), key, "left_anti")


def rules(spark: SparkSession, rewrites: list[str] = (), shortens: list[str] = (), deletes: list[str] = ()) -> dict:
    """The regex tables of names, as lists for expressions; they are written by hand, so they fit the driver."""
    r = [x["value"].split("|", 1) for x in lines(spark, list(rewrites)).orderBy("file", "line").collect()]
    s = [x["value"].replace("\t", "|").split("|") for x in lines(spark, list(shortens)).orderBy("file", "line").collect()]
    return {"rewrites": [(a, b.split(",")) for a, b in (x for x in r if len(x) == 2)], "shortens": [(cc, x[1], x[2] if len(x) > 2 else "") for x in s if len(x) > 1 for cc in x[0].split(",")], "deletes": [x["value"] for x in lines(spark, list(deletes)).orderBy("file", "line").collect() if x["value"]]}


def geojson(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(properties, geometry) of the features of whole-file collections."""
    d = spark.read.text(paths, wholetext=True)
    j = F.from_json("value", "features array<struct<properties: map<string, string>, geometry: string>>")
    return d.select(F.explode(j["features"]).alias("f")).select("f.properties", "f.geometry")


def mapping_config(text: str) -> dict:
    """The settings beside a polygon file: source, name fields, place types by preference, id field."""
    c = json.loads(text)
    return {"source": c.get("source", ""), "names": c.get("nameFields", {}), "levels": c.get("woeTypes", []), "id": c.get("idField")}


def hotfixes(spark: SparkSession, path: str) -> DataFrame:
    """Edit records of the JSON files of a folder."""
    schema = "edits array<struct<longId: bigint, editType: string, population: bigint, lat: double, lng: double, cc: string>>"
    d = spark.read.schema(schema).json(path, multiLine=True, pathGlobFilter="*.json")
    e = d.select(F.posexplode("edits").alias("pos", "e"))
    return e.select(F.col("e.longId").alias("fid"), F.col("pos").cast("bigint").alias("seq"), F.col("e.editType").alias("kind"), "e.population", "e.lat", "e.lng", "e.cc")
