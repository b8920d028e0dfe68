"""The request layer: requests from parameters or JSON, each answered by slug, completion or geocoding, and pruned replies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo
from atlasweave.functions.ids import parse_id
from atlasweave.operators.indexes import resolve
from atlasweave.plans.autocomplete import autocomplete
from atlasweave.plans.geocode import Store, geocode
from atlasweave.session import cut, with_columns

_POINT = "struct<lat:double,lng:double>"
_JSON = f"query string, cc string, lang string, ll {_POINT}, autocomplete boolean, woeHint array<string>, woeRestrict array<string>, bounds struct<ne:{_POINT},sw:{_POINT}>, slug string, radius double, maxInterpretations int, allowedSources array<string>, responseIncludes array<string>, strict boolean, autocompleteBias string"
#: How each bias ranks completions.
BIASES = {"NONE": "default", "BALANCED": "balanced", "LOCAL": "local", "GLOBAL": "global"}


def _by_name_or_number(value: Column, table: dict[str, int]) -> Column:
    """The number of a name, or a number if it is one of the table's; null for others."""
    names = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v)])
    number = value.try_cast("int")
    return F.when(number.isNotNull(), F.when(number.isin(list(table.values())), number)).otherwise(F.element_at(names, F.upper(value)))


def _numbers(values: Column, table: dict[str, int]) -> Column:
    return F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda x: _by_name_or_number(F.trim(x), table)), lambda x: x.isNotNull())


def _names(values: Column, table: dict[str, int]) -> Column:
    by = F.create_map(*[F.lit(x) for k, v in table.items() for x in (v, k)])
    return F.transform(_numbers(values, table), lambda x: F.element_at(by, x))


def _shaped(df: DataFrame, ll: Column, bounds: Column, c) -> DataFrame:
    """Requests with the columns of REQUESTS and REQUEST_OPTIONS from those of the wire."""
    bias = F.create_map(*[F.lit(x) for k, v in BIASES.items() for x in (k, v)])
    box = F.when(bounds.isNotNull(), F.struct(bounds["sw"]["lat"].alias("south"), bounds["sw"]["lng"].alias("west"), bounds["ne"]["lat"].alias("north"), bounds["ne"]["lng"].alias("east")))
    most = c("maxInterpretations")
    return df.select(
        "qid", c("query").alias("query"), c("cc").alias("cc"), F.coalesce(c("lang"), F.lit("en")).alias("lang"), ll["lat"].alias("lat"), ll["lng"].alias("lng"), _numbers(c("woeHint"), S.WOE_NAMES).alias("woe_hint"), F.when(most > 0, most).alias("max_interpretations"),
        box.alias("bounds"), F.when(c("radius") > 0, c("radius")).alias("radius"), F.coalesce(c("strict"), F.lit(False)).alias("strict"), _numbers(c("woeRestrict"), S.WOE_NAMES).alias("woe_restrict"), c("allowedSources").alias("allowed_sources"),
        F.coalesce(c("autocomplete"), F.lit(False)).alias("autocomplete"), F.coalesce(F.element_at(bias, F.get(_names(F.array(c("autocompleteBias")), {k: i for i, k in enumerate(BIASES)}), F.lit(0))), F.lit("balanced")).alias("bias"), c("slug").alias("slug"), _names(c("responseIncludes"), S.INCLUDES).alias("includes"),
    )


def parse_json(rows: DataFrame, column: str = "json") -> DataFrame:
    """(qid, json) to requests; types, includes and the bias are names or numbers. Text that is no JSON gives a request without a query."""
    d = rows.select("qid", F.from_json(F.col(column), _JSON).alias("j"))
    return _shaped(d, F.col("j.ll"), F.col("j.bounds"), lambda name: F.col(f"j.{name}"))


def parse_parameters(rows: DataFrame, column: str = "parameters") -> DataFrame:
    """(qid, parameters) to requests, from the part of an address behind the question mark; of a repeated key the first counts.

    Lists are separated by commas; numbers that can't be read are as if they weren't given.
    """
    parts = F.filter(F.transform(F.split(F.coalesce(F.col(column), F.lit("")), "[&;]"), lambda x: F.struct(F.try_url_decode(F.substring_index(x, "=", 1)).alias("k"), F.try_url_decode(F.when(x.contains("="), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("")).alias("v"))), lambda e: e["k"].isNotNull() & (e["k"] != ""))
    d = rows.select("qid", parts.alias("e"))
    own = lambda name: F.get(F.filter("e", lambda x: x["k"] == name), F.lit(0))["v"]
    many = lambda name: F.split(own(name), ",")
    kinds = {"radius": lambda n: own(n).try_cast("double"), "maxInterpretations": lambda n: own(n).try_cast("int"), "strict": lambda n: own(n).try_cast("boolean"), "autocomplete": lambda n: own(n).try_cast("boolean")}
    kinds |= {n: many for n in ("woeHint", "woeRestrict", "allowedSources", "responseIncludes")}
    ll = F.split(own("ll"), ",")
    point = F.when(F.size(ll) >= 2, F.struct(F.trim(ll[0]).try_cast("double").alias("lat"), F.trim(ll[1]).try_cast("double").alias("lng")))
    return _shaped(d, point, F.lit(None).cast(f"struct<ne:{_POINT},sw:{_POINT}>"), lambda name: kinds.get(name, own)(name))


def mode(slug: str = "slug", flag: str = "autocomplete") -> Column:
    """How a request is answered: a slug goes before completion, and that before geocoding."""
    return F.when(F.length(F.trim(slug)) > 0, "slug").when(F.coalesce(F.col(flag), F.lit(False)), "autocomplete").otherwise("geocode")


def dispatch(requests: DataFrame, store: Store, mapping: DataFrame) -> DataFrame:
    """(qid, mode, rank, fid, score, name, display_name) of all requests, each answered in its mode.

    ``mapping`` (key, fid) tells slugs and other ids; requests without an answer have no row.
    """
    asked = cut(with_columns(requests, S.REQUEST_OPTIONS).withColumn("mode", mode()), "asked")
    names = ["qid", "rank", "fid", "score", "name", "display_name"]
    parts = [geocode(asked.where("mode = 'geocode'").drop("mode"), store).select(*names, F.lit("geocode").alias("mode"))]
    completed = asked.where("mode = 'autocomplete'").withColumn("bias", F.coalesce("bias", F.lit("balanced")))
    for bias in sorted(r["bias"] for r in completed.select("bias").distinct().collect() if r["bias"] in BIASES.values()):  # at most four
        parts.append(autocomplete(completed.where(F.col("bias") == bias).drop("mode"), store, bias).select(*names, F.lit("autocomplete").alias("mode")))
    keys = asked.where("mode = 'slug'").select("qid", F.col("slug").alias("key"))
    found = resolve(keys, mapping, parse_id(F.col("key"))).join(store.labels, "fid")
    from atlasweave.functions.names import best_name

    named = found.join(asked.select("qid", F.coalesce("lang", F.lit("en")).alias("want")), "qid").withColumn("name", best_name(F.col("names"), F.col("want")))
    parts.append(named.select("qid", F.lit(1).alias("rank"), "fid", F.lit(0).cast("bigint").alias("score"), "name", F.col("name").alias("display_name"), F.lit("slug").alias("mode")))
    return reduce(DataFrame.unionByName, parts).select("qid", "mode", *names[1:])


def included(what: str, includes: str = "includes") -> Column:
    """Whether a reply asks for a part; EVERYTHING implies all."""
    return F.coalesce(F.array_contains(includes, what) | F.array_contains(includes, "EVERYTHING"), F.lit(False))


def prune(answers: DataFrame, requests: DataFrame, store: Store) -> DataFrame:
    """(qid, rank, fid) with what the request includes: names (of the place: abbreviations, the request's language and English, or
    all), parents (ids, nearest first) and bounds as text, null where it isn't asked for."""
    asked = with_columns(requests, S.REQUEST_OPTIONS).select("qid", F.coalesce("lang", F.lit("en")).alias("want"), "includes")
    rows = answers.select("qid", "rank", "fid").join(asked, "qid").join(store.labels.select("fid", "names"), "fid").join(store.features.select("fid", "parents", "box"), "fid")
    kept = F.filter("names", lambda n: included("ALL_NAMES") | (n["flags"].bitwiseAND(F.lit(S.ABBREVIATION)) != 0) | n["lang"].isin("en") | (n["lang"] == F.col("want")))
    box = F.when(included("WKT_GEOMETRY") & F.col("box").isNotNull(), geo.box_wkt(F.col("box")))
    return rows.select("qid", "rank", "fid", kept.alias("names"), F.when(included("PARENTS"), F.col("parents")).alias("parents"), box.alias("bounds_wkt"))
