"""Queries over the derived gazetteer, one for each operator or group of operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo, ids, names
from atlasweave.operators import compare, enrich, indexes
from atlasweave.plans import gazetteer as gz
from atlasweave.plans import geocode as gc
from atlasweave.plans import requests as rq
from atlasweave.plans.autocomplete import autocomplete as complete
from atlasweave.plans.reverse import bulk_index, cell_index, coverings, grid_boxes, reverse_geocode, shared_index
from atlasweave.session import with_columns

QUERIES: dict = {}
REWRITES = [(r"widget\b", ["gadget", "wdgt"]), (r"bolt\b", ["screw"]), (r"small\b", ["sm"])]
DELETES = ["red", "blue", "old ring"]
SHORTENS = [("*", "widget", ""), ("AF", "cold", ""), ("AS", "hot", "h"), ("*", "ring", "rg")]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _store(spark: SparkSession, d: str) -> gc.Store:
    return gc.Store.of(gz.features(spark, d), gz.names(spark, d)).written()


def _csv(col, sep=","):
    return F.array_join(F.transform(col, lambda x: x.cast("string")), sep)


@query
def feature_union_first(spark, d) -> DataFrame:
    """Union of all sources, first by priority a normalised name and country."""
    rows = [s.withColumn("id", F.concat_ws("|", "cc", F.lower("name"))).select("id", "fid", "woe", "population", "priority", "key") for s in gz.sources(spark, d)]
    return enrich.union_first(rows, "id", [F.col("priority"), F.col("key")])


@query
def classify_place_type(spark, d) -> DataFrame:
    part = gz.table(spark, d, "part")
    code = F.element_at(F.array(*map(F.lit, ["PPL", "PPLX", "ADM1", "ADM2", "ADM3", "ADMD", "PCLI", "AIRP", "ISL", "PRK", "CONT", "BLDG", "WLL", "RGNE", "XX", "PPLA"])), (F.col("p_partkey") % 16 + 1).cast("int"))
    cls = F.element_at(F.array(*map(F.lit, ["P", "A", "S", "Z", "T"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    cc = F.element_at(F.array(*map(F.lit, ["US", "DE", "FR"])), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = part.select("p_partkey", cls.alias("cls"), code.alias("code"), cc.alias("cc"), "p_name")
    return rows.select("p_partkey", enrich.classify(F.col("cls"), F.col("code")).alias("woe"), enrich.should_index(F.col("cls"), F.col("code"), F.col("p_name"), F.col("cc")).alias("indexed"), geo.level_of(enrich.classify(F.col("cls"), F.col("code"))).alias("level"))


@query
def admin_code_parents(spark, d) -> DataFrame:
    """Paths of codes country.division.customer and those of the higher levels; division 0 is .00."""
    c = gz.table(spark, d, "customer").join(gz.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(gz.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    codes = [F.when(F.col("n_nationkey") % 5 == 0, "00").otherwise(F.col("n_nationkey").cast("string")), F.col("c_custkey").cast("string")]
    level = (F.col("c_custkey") % 3).cast("int")
    cc = F.substring("r_name", 1, 2)
    return c.select("c_custkey", enrich.admin_path(cc, codes, level).alias("path"), F.array_join(enrich.admin_parents(cc, codes, level), "|").alias("parents"))


@query
def enrich_left_joins(spark, d) -> DataFrame:
    """Features with boosts, parents, extra relations and boxes from side tables."""
    li = gz.table(spark, d, "lineitem")
    boosts = li.select(ids.feature_id(6, F.col("l_partkey")).alias("fid"), F.col("l_quantity").cast("bigint").alias("boost")).where("boost > 40")
    parents = li.where("l_linenumber = 1").select(ids.feature_id(6, F.col("l_partkey")).alias("fid"), ids.feature_id(5, F.col("l_suppkey")).alias("parent"))
    extras = li.where("l_linenumber = 7").select(ids.feature_id(6, F.col("l_partkey")).alias("fid"), ids.feature_id(5, F.col("l_suppkey")).alias("extra"))
    boxes = gz.table(spark, d, "supplier").select(ids.feature_id(5, F.col("s_suppkey")).alias("fid"), F.col("s_nationkey").cast("bigint").alias("box"))
    f = gz.features(spark, d).select("fid", "boost", "parents", "extras")
    f = enrich.join_boxes(enrich.join_extras(enrich.join_parents(enrich.join_boosts(f, boosts), parents), extras), boxes)
    return f.select("fid", "boost", _csv(F.col("parents")).alias("parents"), _csv(F.col("extras")).alias("extras"), "box")


@query
def boost_sum(spark, d) -> DataFrame:
    li = gz.table(spark, d, "lineitem")
    return enrich.sum_boosts(li.select("l_partkey", F.col("l_quantity").cast("bigint").alias("boost")), "l_partkey")


@query
def polygon_pick_max(spark, d) -> DataFrame:
    o = gz.table(spark, d, "orders")
    of = lambda s: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("fid"), F.col("o_orderkey").alias("polygon"))
    return enrich.best_polygons(of("F"), of("O"))


@query
def best_level_filter(spark, d) -> DataFrame:
    o = gz.table(spark, d, "orders").withColumn("level", F.substring("o_orderpriority", 1, 1).cast("int"))
    return enrich.best_level(o, ["o_custkey"], "level").select("o_custkey", "o_orderkey", "level")


@query
def name_flag_merge(spark, d) -> DataFrame:
    p = gz.table(spark, d, "part")
    flag = F.element_at(F.array(*map(F.lit, [1, 8, 9, 16, 4])), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = p.select((F.col("p_partkey") % 25).alias("fid"), F.lit("en").alias("lang"), F.col("p_name").alias("name"), flag.alias("flags"))
    return enrich.shadow_deaccented(enrich.merge_names(rows))


@query
def normalize_tokens(spark, d) -> DataFrame:
    rows = gz.table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).union(gz.table(spark, d, "customer").select("c_custkey", "c_name"))
    n = names.normalize(F.col("line"))
    return rows.groupBy("doc_id").agg(F.sum(F.size(names.tokens(n))).alias("n_tokens"), F.max(n).alias("largest"), F.sum(F.length(n)).alias("chars"))


@query
def deaccent_text(spark, d) -> DataFrame:
    return gz.table(spark, d, "documents").select("doc_id", names.deaccent(F.lower("text")).alias("plain"))


@query
def rewrite_shorten_delete(spark, d) -> DataFrame:
    f = gz.features(spark, d).where(f"woe IN ({S.SUBURB}, {S.POI})")
    n, cc = F.col("name"), F.col("cc")
    return f.select("fid", F.array_join(F.array_sort(names.apply_rewrites(n, REWRITES)), "|").alias("rewritten"), names.apply_deletes(n, DELETES).alias("deleted"), names.shortest(n, cc, SHORTENS).alias("short"), F.array_join(names.polygon_names(F.concat(n, F.lit(" ("), cc, F.lit(")"))), "|").alias("parts"))


@query
def name_similarity(spark, d) -> DataFrame:
    """Best similarity of each part name to the other names of its brand."""
    p = gz.table(spark, d, "part").select("p_brand", "p_name").distinct()
    pairs = p.join(p.withColumnRenamed("p_name", "other"), "p_brand").where("p_name < other")
    scored = pairs.withColumn("s", F.round(names.similarity("p_name", "other"), 4))
    return scored.groupBy("p_brand", "p_name").agg(F.max("s").alias("best"), F.sum((F.col("s") > 95).cast("int")).alias("accepted"))


@query
def name_index_build(spark, d) -> DataFrame:
    return indexes.name_index(gz.names(spark, d), gz.features(spark, d)).select("name", _csv(F.col("fids")).alias("fids"))


@query
def prefix_index_topk(spark, d) -> DataFrame:
    return indexes.prefix_index(gz.names(spark, d), gz.features(spark, d))


@query
def prefix_lookup_cap(spark, d) -> DataFrame:
    """Prefixes of part names, capped at 100 places."""
    q = gz.table(spark, d, "part").select(F.substring("p_name", 1, 4).alias("prefix")).distinct().select(F.xxhash64("prefix").alias("qid"), "prefix")
    return indexes.prefix_lookup(q, indexes.name_rows(gz.names(spark, d), gz.features(spark, d)), 100).join(q, "qid").select("prefix", "name", "fid")


@query
def feature_id_codec(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    text = F.concat(F.lit("geonameid:"), ids.local_of(F.col("fid")).cast("string"))
    return f.select("fid", ids.namespace_of(F.col("fid")).alias("ns"), ids.local_of(F.col("fid")).alias("local"), ids.namespace_order(F.col("fid")).alias("quality"), ids.parse_id(text).alias("parsed"), ids.parse_id(F.col("fid").cast("string")).alias("long_id"))


@query
def postal_id_codec(spark, d) -> DataFrame:
    c = gz.table(spark, d, "customer")
    cc = F.element_at(F.array(*map(F.lit, ["US", "FR", "GB", "XX"])), (F.col("c_custkey") % 4 + 1).cast("int"))
    code = F.concat(F.lit("1"), F.right(F.concat(F.lit("0000"), F.col("c_custkey").cast("string")), F.lit(4)), F.when(F.col("c_custkey") % 3 == 0, " CEDEX").otherwise(""))
    rows = c.select("c_custkey", cc.alias("cc"), code.alias("code"))
    return rows.select("c_custkey", ids.postal_id(F.col("cc"), F.col("code")).alias("packed")).withColumn("parts", ids.postal_parts(F.col("packed"))).select("c_custkey", "packed", F.col("parts.cc").alias("cc"), F.col("parts.code").alias("code"))


@query
def best_name(spark, d) -> DataFrame:
    """The name shown in English and in an unknown language, and with abbreviations preferred."""
    n = gz.names(spark, d).groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "lang", "flags"))).alias("names"))
    return n.select("fid", names.best_name(F.col("names"), F.lit("en")).alias("en"), names.best_name(F.col("names"), F.lit("fr")).alias("fr"), names.best_name(F.col("names"), F.lit("en"), F.lit(True)).alias("short"))


def _requests(spark, d) -> DataFrame:
    """One request a customer: its name and division, half of them with a country hint."""
    o = gz.table(spark, d, "nation")
    c = gz.table(spark, d, "customer").join(o.select(F.col("n_nationkey").alias("k"), "n_name", "n_regionkey"), F.col("c_nationkey") == F.col("k"))
    cc = F.when(F.col("c_custkey") % 2 == 0, F.lit(None)).otherwise(F.element_at(F.array(*map(F.lit, ["AF", "AM", "AS", "EU", "MI"])), F.col("n_regionkey") + 1))
    q = F.concat(F.lit("pizza "), "c_name", F.lit(", "), "n_name")
    return c.select(F.col("c_custkey").alias("qid"), q.alias("query"), cc.alias("cc"), F.lit("en").alias("lang"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("array<int>").alias("woe_hint"), F.lit(3).alias("max_interpretations"))


@query
def request_filters(spark, d) -> DataFrame:
    """Requests that restrict types, sources, or strictly country and bounds."""
    q = _requests(spark, d)
    k = F.col("qid") % 4
    box = F.struct(F.lit(-80.0).alias("south"), F.lit(-180.0).alias("west"), F.lit(0.0).alias("north"), F.lit(180.0).alias("east"))
    q = q.withColumn("woe_restrict", F.when(k == 1, F.array(F.lit(S.TOWN)))).withColumn("allowed_sources", F.when(k == 2, F.array(F.lit("geonameid"), F.lit("none")))).withColumn("strict", k == 3).withColumn("bounds", F.when(k == 3, box))
    return gc.geocode(q, _store(spark, d)).select("qid", "rank", "fid", "score")


@query
def request_parse(spark, d) -> DataFrame:
    """Requests from parameters (odd customers) and JSON (even ones), and how each is answered."""
    c = gz.table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    name = F.replace("c_name", F.lit("#"), F.lit("%23"))
    nation = F.col("c_nationkey").cast("string")
    odd = c.where("c_custkey % 2 = 1").select(F.col("c_custkey").alias("qid"), F.concat(F.lit("query="), name, F.lit("+x&ll=1.5,"), nation, F.lit("&woeHint=7,SUBURB,NOPE&radius=30&maxInterpretations="), nation, F.when(F.col("c_nationkey") % 2 == 0, "&autocomplete=true&autocompleteBias=LOCAL").otherwise("&slug=s"), F.lit("&allowedSources=osm,tgn&responseIncludes=2,PARENTS")).alias("parameters"))
    text = F.concat(F.lit('{"query":"'), "c_name", F.lit(' x","ll":{"lat":1.5,"lng":'), nation, F.lit('},"woeHint":["TOWN","22","NOPE"],"radius":30,"maxInterpretations":'), nation, F.when(F.col("c_nationkey") % 2 == 0, ',"autocomplete":true,"autocompleteBias":"2"').otherwise(',"slug":"s"'), F.lit(',"allowedSources":["osm","tgn"],"responseIncludes":["ALL_NAMES",1],"bounds":{"ne":{"lat":2,"lng":3},"sw":{"lat":0,"lng":1}}}'))
    even = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("qid"), text.alias("json"))
    rows = rq.parse_parameters(odd).unionByName(rq.parse_json(even))
    return rows.select("qid", "query", "lat", "lng", F.array_join(F.transform("woe_hint", lambda x: x.cast("string")), ",").alias("hints"), "radius", "max_interpretations", F.array_join("allowed_sources", ",").alias("sources"), F.array_join("includes", ",").alias("includes"), "bias", rq.mode().alias("mode"), F.col("bounds.west").alias("west"))


@query
def primary_promotion(spark, d) -> DataFrame:
    """Names of towns after their alternate names are known."""
    c = gz.table(spark, d, "customer")
    k, fid = F.col("c_custkey") % 5, ids.feature_id(3, F.col("c_custkey"))
    own = c.select(fid.alias("fid"), F.col("c_name").alias("name"), F.lit("en").alias("lang"), F.lit(S.PREFERRED).alias("flags"))
    other = F.when(k == 1, F.struct(F.col("c_name").alias("name"), F.lit("en").alias("lang"), F.lit(S.PREFERRED).alias("flags"))).when(k == 2, F.struct(F.col("c_name").alias("name"), F.lit("en").alias("lang"), F.lit(0).alias("flags"))).when(k == 3, F.struct(F.col("c_mktsegment").alias("name"), F.lit("en").alias("lang"), F.lit(S.PREFERRED).alias("flags"))).when(k == 4, F.struct(F.col("c_mktsegment").alias("name"), F.lit("fr").alias("lang"), F.lit(0).alias("flags")))
    alternates = c.select(fid.alias("fid"), other.alias("o")).where("o IS NOT NULL").select("fid", "o.*")
    return enrich.promote_primary(own, alternates, gz.features(spark, d).select("fid", "woe", "cc"))


@query
def phrase_match(spark, d) -> DataFrame:
    parsed = gc.parse_requests(_requests(spark, d))
    return gc.matches(parsed, _store(spark, d)).select("qid", "start", "end", F.col("feat.fid").alias("fid"))


@query
def geocode_requests(spark, d) -> DataFrame:
    return gc.geocode(_requests(spark, d), _store(spark, d)).select("qid", "rank", "fid", "score", "what", F.col("where").alias("place"), "display_name", "fids")


def _varied(spark, d) -> DataFrame:
    """Places of every type, language, flag, boost and country that a score looks at, by their keys."""
    f = gz.features(spark, d)
    k = F.col("key")
    every = lambda n: k % n == 0
    woe = F.when(every(19), S.UNKNOWN).when(every(17), S.AIRPORT).when(every(10), S.ADMIN2).when(every(9), S.POSTAL_CODE).otherwise(F.col("woe")).cast("int")
    box = F.when(every(7), F.struct((F.col("lat") - 0.1).alias("south"), (F.col("lng") - 0.1).alias("west"), (F.col("lat") + 0.1).alias("north"), (F.col("lng") + 0.1).alias("east")))
    return f.select(
        "fid", "key", F.when(every(5), "US").otherwise(F.col("cc")).alias("cc"), woe.alias("woe"), "lat", "lng", "population", (k % 100).cast("bigint").alias("boost"), "parents", "extras", every(3).alias("has_poly"), "can_geocode",
        box.alias("box"), F.when(every(23), F.lit(True)).alias("world_city"), F.lit(None).cast("array<string>").alias("other_ids"), F.array(F.when(every(13), "xx").otherwise("en")).alias("langs"),
        F.array(F.when(every(11), S.NEVER_DISPLAY).otherwise(S.PREFERRED)).alias("flags"), F.lit(0).alias("start"), F.lit(1).alias("end"),
    )


@query
def score_profiles(spark, d) -> DataFrame:
    """Scores of places under each profile, with a hint of place and country; some are repeated, some have a division."""
    f = _varied(spark, d)
    division = F.struct(*(F.lit(7).cast("int").alias(n) if n == "ord" else F.lit(None if n != "fid" else -1).cast(f.select(gc.feat().alias("x")).schema["x"].dataType[n].dataType).alias(n) for n in f.select(gc.feat().alias("x")).schema["x"].dataType.names))
    feats = F.when(F.col("key") % 29 == 0, F.array(gc.feat(), gc.feat())).when(F.col("key") % 2 == 0, F.array(gc.feat(), division)).otherwise(F.array(gc.feat()))
    rows = f.select("fid", feats.alias("feats"), F.lit("AF").alias("cc"), F.lit("en").alias("lang"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"), F.array(F.lit(S.SUBURB)).alias("woe_hint"))
    return with_columns(rows, S.REQUEST_OPTIONS).select("fid", *(gc.score(p).alias(p) for p in S.PROFILES))


@query
def bounds_distance(spark, d) -> DataFrame:
    """Scores with bounds in place of a point: small ones that hold the centre, that meet the place's own, and wide ones."""
    f = _varied(spark, d)
    off = F.when(F.col("key") % 4 == 0, 0.0).when(F.col("key") % 4 == 1, 0.75).when(F.col("key") % 4 == 2, 5.0).otherwise(0.0)
    half = F.when(F.col("key") % 4 == 3, 20.0).otherwise(0.7)
    y = F.col("lat") + off
    box = F.struct((y - half).alias("south"), (F.col("lng") - half).alias("west"), (y + half).alias("north"), (F.col("lng") + half).alias("east"))
    none = lambda t: F.lit(None).cast(t)
    rows = f.select("fid", F.array(gc.feat()).alias("feats"), none("string").alias("cc"), F.lit("en").alias("lang"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lng"), none("array<int>").alias("woe_hint"), box.alias("bounds"))
    return with_columns(rows, S.REQUEST_OPTIONS).select("fid", gc.score("geocode").alias("score"), gc.score("local").alias("local"))


@query
def dedupe_interpretations(spark, d) -> DataFrame:
    """Parts as places on a small grid, asked for by brand: those of one name that lie together are one."""
    k = F.col("p_partkey")
    p = gz.table(spark, d, "part").select(
        F.col("p_brand").alias("brand"), ids.feature_id(6, k).alias("fid"), F.lit("US").alias("cc"), F.when(k % 3 == 0, S.TOWN).when(k % 3 == 1, S.ADMIN2).otherwise(S.SUBURB).cast("int").alias("woe"), ((k % 40) * 0.1 - 2).alias("lat"), ((k % 7) * 0.13 - 0.4).alias("lng"), F.floor("p_retailprice").alias("population"),
        F.lit(0).cast("bigint").alias("boost"), F.array().cast("array<bigint>").alias("parents"), F.array().cast("array<bigint>").alias("extras"), (k % 5 == 0).alias("has_poly"), F.lit(True).alias("can_geocode"), F.col("p_name").alias("name"), F.when(k % 4 == 0, S.ALIAS).otherwise(S.PREFERRED).alias("flags"),
    )
    store = gc.Store.of(p, p.select("fid", "name", F.lit("en").alias("lang"), "flags", F.lit(0).alias("pos")))
    q = F.substring("brand", 7, 5).cast("bigint")
    rank = F.row_number().over(W.partitionBy("brand").orderBy(F.desc("population"), "fid"))
    rows = with_columns(p, S.FEATURE_OPTIONS).withColumn("langs", F.array(F.lit("en"))).withColumn("flags", F.array("flags")).withColumn("start", F.lit(0)).withColumn("end", F.lit(1))
    rows = rows.select(q.alias("qid"), rank.alias("rank"), "fid", F.array(gc.feat()).alias("feats"), F.array(F.lit(S.SUBURB)).alias("woe_hint"), F.lit("brand").alias("unused"))
    return gc.merge_same_places(rows, store.labels).select("qid", "rank", "fid", F.size("merged").alias("n"))


@query
def dedupe_by_primary(spark, d) -> DataFrame:
    """Line items as interpretations: the best of each part and order, then ranked."""
    rows = compare.best_of_each(gz.table(spark, d, "lineitem"), "l_orderkey", "l_partkey", [F.desc("l_quantity"), F.col("l_linenumber"), F.col("l_suppkey")], [F.desc("l_quantity"), F.col("l_partkey")], 3)
    return rows.select("l_orderkey", "rank", "l_partkey", F.col("l_quantity").cast("bigint").alias("score"))


@query
def ambiguous_names(spark, d) -> DataFrame:
    """Places that share name and country with others, and how many do."""
    return compare.ambiguous(gz.features(spark, d).select("fid", "cc", F.lower("name").alias("label")), ["cc", "label"]).select("fid", "n")


@query
def autocomplete_requests(spark, d) -> DataFrame:
    c = gz.table(spark, d, "customer")
    q = c.select(F.col("c_custkey").alias("qid"), F.expr("left(c_name, length(c_name) - 1)").alias("query"), F.lit("AF").alias("cc"), F.lit("en").alias("lang"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("array<int>").alias("woe_hint"), F.lit(3).alias("max_interpretations"))
    return complete(q, _store(spark, d)).select("qid", "rank", "fid", "score", "name")


@query
def distance_buckets(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    a = f.where(f"woe = {S.ADMIN1}").select(F.col("fid").alias("a"), F.col("lat").alias("alat"), F.col("lng").alias("alng"), F.get("parents", F.lit(0)).alias("p"))
    b = f.where(f"woe = {S.TOWN}").select(F.col("fid").alias("b"), F.col("lat").alias("blat"), F.col("lng").alias("blng"), F.get("parents", F.lit(1)).alias("p"))
    m = geo.distance_meters(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng"))
    rows = a.join(b, "p").select("a", F.least(F.lit(20), F.floor(m / 1_000_000)).alias("bucket"), geo.miles(F.col("alat"), F.col("alng"), F.col("blat"), F.col("blng")).alias("miles"))
    return rows.groupBy("a", "bucket").agg(F.count("*").alias("n"), F.floor(F.max("miles")).alias("miles"))


@query
def bounds_hint(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    box = lambda s, w, n, e: geo.in_bounds(F.col("lat"), F.col("lng"), F.lit(s), F.lit(w), F.lit(n), F.lit(e))
    return f.select("fid", box(-10.0, -20.0, 30.0, 40.0).alias("plain"), box(-50.0, 170.0, 50.0, -170.0).alias("wrapped"))


@query
def quantized_bucket(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    return f.groupBy("cc", geo.bucket(F.col("lat")).alias("by"), geo.bucket(F.col("lng")).alias("bx")).agg(F.count("*").alias("n"), F.max_by("fid", F.struct("population", "fid")).alias("best"))


@query
def grid_reverse_geocode(spark, d) -> DataFrame:
    """Customers' places in boxes around the divisions."""
    f = gz.features(spark, d)
    boxes = f.where(f"woe = {S.ADMIN1}").select("fid", (F.col("lat") - 12).alias("south"), (F.col("lng") - 25).alias("west"), (F.col("lat") + 12).alias("north"), (F.col("lng") + 25).alias("east"))
    return grid_boxes(f.where(f"woe = {S.TOWN}").select(F.col("fid").alias("qid"), "lat", "lng"), boxes)


@query
def bulk_reply_index(spark, d) -> DataFrame:
    li = gz.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("fid"))
    rows = li.select((F.col("l_orderkey") % 100).alias("batch"), F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), "fid")
    return bulk_index(rows)[1].select("batch", "qid", _csv(F.col("positions")).alias("positions"))


def _edits(spark, d) -> DataFrame:
    o = gz.table(spark, d, "orders")
    kind = F.when((F.col("o_orderstatus") == "F") & (F.col("o_orderkey") % 7 == 0), "Remove").when(F.col("o_orderstatus") == "P", "Add").otherwise("Modify")
    return o.select(ids.feature_id(3, F.col("o_custkey")).alias("fid"), F.col("o_orderkey").alias("seq"), kind.alias("kind"), F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice")).cast("bigint").alias("population"), F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_orderkey") % 90).cast("double")).alias("lat"), F.lit(None).cast("double").alias("lng"))


@query
def edit_apply(spark, d) -> DataFrame:
    f = gz.features(spark, d).where(f"woe = {S.TOWN}").select("fid", "population", "lat", "lng")
    return enrich.apply_edits(f, _edits(spark, d))


@query
def hotfix_overlay(spark, d) -> DataFrame:
    f = gz.features(spark, d).select("fid", "cc", "population")
    e = gz.table(spark, d, "events").groupBy("user_id").agg(F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("population"), F.bool_or(F.col("event_type") == "error").alias("gone"))
    e = e.withColumn("fid", ids.feature_id(3, F.col("user_id")))
    return enrich.overlay(f, e.select("fid", F.lit("XX").alias("cc"), "population"), e.where("gone AND user_id % 3 = 0"))


@query
def slug_assign(spark, d) -> DataFrame:
    """Slugs name, then name-country, then with the local id; better places choose first."""
    f = gz.features(spark, d).withColumn("base", names.slug(F.col("name")))
    local = ids.local_of(F.col("fid")).cast("string")
    options = F.array(F.col("base"), F.concat_ws("-", "base", F.lower("cc")), F.concat_ws("-", F.col("base"), F.lower("cc"), F.col("woe").cast("string"), local))
    return indexes.assign_slugs(f.select("fid", F.col("population").alias("score"), F.posexplode(options).alias("option", "slug")))


@query
def id_mapping_build(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    slugs = f.select(F.regexp_replace(F.lower("name"), "[ #]", "-").alias("slug"), "fid")
    others = f.select(ids.local_of(F.col("fid")).alias("other"), "fid")
    return indexes.id_mapping(f, slugs, others)


@query
def slug_lookup(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    mapping = indexes.id_mapping(f, f.select(F.regexp_replace(F.lower("name"), "[ #]", "-").alias("slug"), "fid"), f.select(ids.local_of(F.col("fid")).alias("other"), "fid"))
    c = gz.table(spark, d, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, F.regexp_replace(F.lower("c_name"), "[ #]", "-")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("adhoc:"), F.col("c_custkey").cast("string"))).otherwise(F.lit("no-such-place"))
    return indexes.resolve(c.select(F.col("c_custkey").alias("qid"), key.alias("key")), mapping, ids.parse_id(F.col("key")))


@query
def semi_join_notable(spark, d) -> DataFrame:
    p, li = gz.table(spark, d, "part"), gz.table(spark, d, "lineitem")
    return compare.notable(p.where("p_type = 'PROMO'"), li.where("l_returnflag = 'R' AND l_quantity > 45"), F.col("p_partkey") == F.col("l_partkey")).select("p_partkey", "p_name")


@query
def eval_diff_counts(spark, d) -> DataFrame:
    """Two rankings of the orders' parts, compared: outcome classes and how often each came. An order without a value isn't ranked."""
    li = gz.table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("x"))
    return compare.outcomes(compare.top_of(li, "l_orderkey", "l_partkey", "q", "old"), compare.top_of(li, "l_orderkey", "l_partkey", "x", "new"), "l_orderkey")


@query
def missing_parents(spark, d) -> DataFrame:
    """Parents that are wanted but not in hand: divisions of towns without suppliers."""
    f = gz.features(spark, d)
    want = f.where(f"woe = {S.TOWN}").select(F.explode("parents").alias("fid"))
    have = gz.table(spark, d, "supplier").where("s_acctbal > 5000").select(ids.feature_id(1, F.col("s_nationkey")).alias("fid"))
    return compare.missing(want, have, "fid")


@query
def order_keys(spark, d) -> DataFrame:
    """Signed cell-like keys in unsigned order, by rank within their supplier."""
    li = gz.table(spark, d, "lineitem").select("l_suppkey", ((F.col("l_orderkey") - 5000) * 7 + F.col("l_linenumber")).alias("cell"))
    return compare.ordered_keys(li, "l_suppkey", "cell")


@query
def list_edits(spark, d) -> DataFrame:
    """Parents of towns after one list edit each: add (remove and append) or remove a country or division."""
    f = gz.features(spark, d).where(f"woe = {S.TOWN}")
    k = F.col("key") if "key" in f.columns else ids.local_of(F.col("fid"))
    f = f.select("fid", "parents", F.when(k % 3 == 0, "Add").when(k % 3 == 1, "Remove").otherwise("NoOp").alias("kind"), F.get("parents", (k % 2).cast("int")).alias("v"))
    f = f.withColumn("done", enrich.list_edit(F.col("parents"), F.col("kind"), F.col("v")))
    return f.select("fid", _csv(F.col("done")).alias("parents"), (F.size("done") == 0).alias("emptied"))


@query
def concordances(spark, d) -> DataFrame:
    """Ids of divisions with those of their suppliers appended."""
    f = gz.features(spark, d).where(f"woe = {S.ADMIN1}").select("fid")
    more = gz.table(spark, d, "supplier").select(ids.feature_id(1, F.col("s_nationkey")).alias("fid"), F.col("s_suppkey").alias("other"))
    return enrich.join_concordances(f, more).select("fid", _csv(F.col("ids")).alias("ids"))


@query
def slug_join(spark, d) -> DataFrame:
    """Customers' orders as slugs: current before deprecated, best first, the first is shown."""
    f = gz.features(spark, d).where(f"woe = {S.TOWN}").select("fid")
    o = gz.table(spark, d, "orders").select(ids.feature_id(3, F.col("o_custkey")).alias("fid"), F.concat(F.lit("s"), F.col("o_orderkey").cast("string")).alias("slug"), F.floor("o_totalprice").alias("score"), (F.col("o_orderstatus") == "F").alias("deprecated"))
    return enrich.join_slugs(f, o).select("fid", "slug", F.array_join("slugs", ",").alias("slugs"))


@query
def attribute_join(spark, d) -> DataFrame:
    """Attributes of parts: the smallest row of each, present fields only."""
    f = gz.features(spark, d).where(f"woe IN ({S.SUBURB}, {S.POI})").select("fid", F.lit(20).alias("scalerank"))
    a = gz.table(spark, d, "lineitem").select(ids.feature_id(6, F.col("l_partkey")).alias("fid"), F.col("l_linenumber").alias("scalerank"), F.when(F.col("l_returnflag") == "R", F.lit(1)).alias("worldcity"))
    return enrich.join_attributes(f, a, ["scalerank", "worldcity"])


@query
def extract_divisions(spark, d) -> DataFrame:
    """Gazetteer lines of class A whose codes go as deep as their level."""
    from atlasweave.sources.readers import extract_admin

    n = gz.table(spark, d, "nation")
    k = F.col("n_nationkey")
    cells = [k.cast("string"), F.col("n_name"), F.lower("n_name"), F.lit(""), F.lit("1"), F.lit("2"), F.when(k % 4 == 3, "P").otherwise("A"), F.concat(F.lit("ADM"), (k % 4 + 1).cast("string")), F.lit("US"), F.lit(""), F.concat(F.lit("S"), (k % 5).cast("string")), F.when(k % 2 == 1, k.cast("string")).otherwise(""), *[F.lit("")] * 7]
    return extract_admin(n.select(F.concat_ws("\t", *cells).alias("value")))


@query
def round_robin_countries(spark, d) -> DataFrame:
    """Fifty towns, one of each country in turn, the most populous first."""
    f = gz.features(spark, d).where(f"woe = {S.TOWN}").select("fid", "cc", "population")
    return indexes.round_robin(f, "cc", [F.desc("population"), F.col("fid")], 50)


# without SQL: cells, polygons, exact geometry


def _polygons(spark, d) -> DataFrame:
    """A circle of 5 km around each town."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def around(lat, lng):
        import pandas as pd

        return pd.Series(geo.circles_wkb(lat.to_numpy(), lng.to_numpy(), 5000.0))

    towns = gz.features(spark, d).where(f"woe = {S.TOWN}").select("fid", "lat", "lng")
    return towns.repartition(spark.sparkContext.defaultParallelism).select("fid", around("lat", "lng").alias("wkb"))


@query
def s2_cells(spark, d) -> DataFrame:
    """Cells a little off the places, and their ancestors."""
    f = gz.features(spark, d)
    cell = geo.cell_udf(12)(F.col("lat") + 0.0137, F.col("lng") + 0.0171)
    return f.select("fid", cell.alias("cell")).withColumn("parent", geo.cell_parent(F.col("cell"), 8))


@query
def s2_coverings(spark, d) -> DataFrame:
    return coverings(_polygons(spark, d), (8, 12))


@query
def rev_geo_index_build(spark, d) -> DataFrame:
    return cell_index(_polygons(spark, d)).cells.where("leaf").groupBy("cell").agg(F.count("*").alias("places"), F.sum(F.col("full").cast("int")).alias("full"))


@query
def reverse_geocode_points(spark, d) -> DataFrame:
    f = gz.features(spark, d)
    points = f.where(f"woe IN ({S.SUBURB}, {S.POI})").select(F.col("fid").alias("qid"), "lat", "lng", F.when(F.col("fid") % 2 == 0, 800.0).alias("radius"))
    return reverse_geocode(points, shared_index(_polygons(spark, d)), f, 5)


@query
def reverse_geocode_boxes(spark, d) -> DataFrame:
    """Suburbs and points of interest in squares around the towns and wide boxes around the divisions."""
    from pyspark.sql import types as T

    @F.pandas_udf(T.BinaryType())
    def square(lat, lng, half):
        import pandas as pd

        return pd.Series([geo.write_wkb([[geo.box_ring(max(-90.0, a - h), b - h, min(90.0, a + h), b + h)]]) for a, b, h in zip(lat, lng, half)])

    f = gz.features(spark, d)
    shapes = f.where(f"woe IN ({S.TOWN}, {S.ADMIN1})").select("fid", square(F.col("lat"), F.col("lng"), F.when(F.col("woe") == S.TOWN, 0.33).otherwise(21.07)).alias("wkb"))
    points = f.where(f"woe IN ({S.SUBURB}, {S.POI})").select(F.col("fid").alias("qid"), "lat", "lng")
    return reverse_geocode(points, shared_index(shapes), f, 5).select("qid", "rank", "fid")


@query
def highlight_names(spark, d) -> DataFrame:
    c = gz.table(spark, d, "customer")
    return c.select("c_custkey", names.highlight("c_name", F.expr("left(c_name, 11)")).alias("marked"))
