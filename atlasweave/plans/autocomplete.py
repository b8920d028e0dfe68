"""Completion of typed prefixes: the last run of tokens is a prefix, earlier ones are whole names, most specific first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo
from atlasweave.functions.names import normalize
from atlasweave.operators.indexes import prefix_lookup
from atlasweave.plans.geocode import ASKED, DEPENDENT, MAX_TOKENS, Store, _sorted, display, feat, parent_country, parse_requests, score, wanted
from atlasweave.session import cut

#: (profile, least score) of the rankers that a balanced answer is merged from, in order; each gives one place.
BALANCED = [("world_city", 0), ("strict_local", 0), ("in_country", 1_000_000), ("global", 1_000_000), ("local", 0)]


#: Names that completion looks at have one of these flags, or no language.
TYPED = S.PREFERRED | S.ABBREVIATION | S.LOCAL_LANG | S.ALT_NAME | S.DEACCENT | S.HISTORIC | S.SHORT_NAME | S.ALIAS


def _grouped(rows: DataFrame, *keys: str) -> DataFrame:
    """Names that were hit, by place: languages, flags, and the languages that later names may have: those of PREFERRED ones if any."""
    preferred = F.array_sort(F.collect_set(F.when(F.col("flags").bitwiseAND(F.lit(S.PREFERRED)) != 0, F.col("lang"))))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set("lang")).alias("langs"), F.array_sort(F.collect_set("flags")).alias("flags"), preferred.alias("best"))
    return out.withColumn("allowed", F.when(F.size("best") > 0, F.col("best")).otherwise(F.col("langs"))).drop("best")


def completions(requests: DataFrame, store: Store) -> tuple[DataFrame, DataFrame]:
    """(parsed, (qid, start, feats)): parses that cover all tokens from the first, left to right.

    The first run names a place, whole or, if it reaches the end, by prefix. A space behind the last token ends the word: names go
    on with a space, or are whole, then of a postal code or a PREFERRED or ALT_NAME one. Each later run must name a parent or an
    extra relation of a place before, or the country that its country depends on, in English, an abbreviation, the request's
    language or one in which the first place was named.
    """
    parsed = cut(parse_requests(requests).withColumn("space", F.col("query").endswith(" ")), "requests")
    heads = parsed.select("qid", "tokens", "n", "space", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("end"))
    heads = heads.select("qid", "n", "space", "end", F.array_join(F.slice("tokens", F.lit(1), F.col("end")), " ").alias("phrase"))
    named = cut(store.names.select("fid", normalize(F.col("name")).alias("name"), "lang", "flags").where((F.col("name") != "") & ((F.col("flags").bitwiseAND(F.lit(TYPED)) != 0) | (F.col("lang") == ""))), "named")
    exact = heads.where("end < n OR space").join(named.withColumnRenamed("name", "phrase"), "phrase").join(store.features.select("fid", "woe"), "fid")
    good = (F.col("woe") == S.POSTAL_CODE) | (F.col("flags").bitwiseAND(F.lit(S.PREFERRED | S.ALT_NAME)) != 0)
    whole = exact.where((F.col("end") < F.col("n")) | good).select("qid", "end", "fid", "lang", "flags")
    typed = heads.where("end = n").select("qid", "end", F.when(F.col("space"), F.concat("phrase", F.lit(" "))).otherwise(F.col("phrase")).alias("prefix"))
    by_prefix = prefix_lookup(typed.select("qid", "prefix"), store.rows).join(typed, "qid").join(named, ["fid", "name"]).select("qid", "end", "fid", "lang", "flags")
    first = _grouped(whole.unionByName(by_prefix), "qid", "end", "fid")
    step = cut(first.join(store.features, "fid").withColumn("start", F.lit(0)).select("qid", "end", "allowed", F.array(feat()).alias("feats")), "step")
    done = [step.join(parsed.select("qid", "n"), "qid").where("end = n").select("qid", "feats")]
    countries = store.features.where(F.col("woe") == S.COUNTRY).where(F.col("cc").isin(list(DEPENDENT))).select(F.col("fid"), F.col("cc").alias("of"))
    for _ in range(MAX_TOKENS - 1):
        open_ = step.join(parsed.select("qid", "n", "tokens", F.coalesce("lang", F.lit("en")).alias("want")), "qid").where("end < n")
        if not open_.limit(1).count():
            break
        open_ = open_.select("qid", "n", "want", "allowed", "tokens", "feats", F.col("end").alias("start"))
        kin = open_.withColumn("fid", F.explode(F.array_distinct(F.flatten(F.transform("feats", lambda f: F.concat(f["parents"], f["extras"]))))))
        lent = open_.withColumn("of", F.explode(F.array_distinct(F.filter(F.transform("feats", lambda f: parent_country(f["cc"])), lambda c: c.isNotNull())))).join(countries, "of").drop("of")
        kin = kin.unionByName(lent.select(*kin.columns)).distinct().where(~F.exists("feats", lambda f: f["fid"] == F.col("fid")))
        hit = kin.join(named, "fid").withColumn("rest", F.array_join(F.slice("tokens", F.col("start") + 1, F.col("n")), " "))
        size = F.size(F.split("name", " "))
        at_end = F.col("name").startswith(F.col("rest"))
        run = F.col("rest").startswith(F.concat("name", F.lit(" ")))
        fine = F.col("lang").isin("en", "abbr") | (F.col("lang") == F.col("want")) | F.array_contains("allowed", F.col("lang"))
        hit = hit.where((at_end | run) & fine).withColumn("end", F.when(at_end, F.col("n")).otherwise(F.col("start") + size))
        grouped = _grouped(hit.withColumnRenamed("allowed", "kept"), "qid", "start", "end", "fid", "feats", "kept").drop("allowed")
        step = cut(grouped.withColumnRenamed("feats", "before").join(store.features, "fid").select("qid", "end", F.col("kept").alias("allowed"), F.concat("before", F.array(feat())).alias("feats")), "step")
        done.append(step.join(parsed.select("qid", "n"), "qid").where("end = n").select("qid", "feats"))
    rows = reduce(DataFrame.unionByName, done).select("qid", F.lit(0).alias("start"), _sorted(F.col("feats")).alias("feats"))
    return parsed, rows


def balanced(rows: DataFrame) -> DataFrame:
    """(qid, fid, group, score): merges rankers in order, each takes its best place not taken before if its score is high
    enough; the rest by default.

    All scores are taken first, so that the windows, all by request, sort numbers in place of parses.
    """
    out = rows.select("qid", "fid", *(score(p).alias(f"s{i}") for i, (p, _) in enumerate(BALANCED)), score("default").alias("rest"))
    out = out.withColumn("group", F.lit(None).cast("int")).withColumn("score", F.lit(None).cast("bigint"))
    for i, (_, least) in enumerate(BALANCED):
        free = F.col("group").isNull() & (F.col(f"s{i}") >= least)
        out = out.withColumn("#free", free).withColumn("#n", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("#free"), F.desc(f"s{i}"), "fid")))
        taken = F.col("#free") & (F.col("#n") == 1)
        out = out.withColumn("score", F.when(taken, F.col(f"s{i}")).otherwise(F.col("score"))).withColumn("group", F.when(taken, i).otherwise(F.col("group"))).drop("#free", "#n")
    return out.select("qid", "fid", F.coalesce("group", F.lit(len(BALANCED))).alias("group"), F.coalesce("score", "rest").alias("score"))


def autocomplete(requests: DataFrame, store: Store, bias: str = "balanced", restrict: str | None = None) -> DataFrame:
    """(qid, rank, fid, score, name, display_name, highlighted_name): three completions a request unless it says otherwise.

    bias is balanced, local, global or default. Countries, continents and first divisions aren't offered as the primary
    place unless the request restricts types or ``restrict`` (a condition on feats) is given.
    """
    parsed, rows = completions(requests, store)
    one = F.get("feats", F.lit(0))
    rows = rows.join(parsed.select("qid", *ASKED), "qid").where(wanted(one))
    free = (F.coalesce(F.size("woe_restrict"), F.lit(0)) <= 0) & one["woe"].isin(S.ADMIN1, S.CONTINENT, S.COUNTRY)
    rows = rows.where(restrict) if restrict else rows.where(~free)
    rows = rows.withColumn("fid", one["fid"]).withColumn("#", F.row_number().over(W.partitionBy("qid", "fid").orderBy(F.size("feats"), F.array_join(F.transform("feats", lambda f: f["fid"].cast("string")), ",")))).where("`#` = 1").drop("#")
    rows = cut(rows, "completions")
    merged = balanced(rows) if bias == "balanced" else rows.select("qid", "fid", score(bias).alias("score"), F.lit(0).alias("group"))
    place = F.row_number().over(W.partitionBy("qid").orderBy("group", F.desc("score"), "fid"))
    best = merged.withColumn("rank", place).join(parsed.select("qid", "max_interpretations"), "qid").where(F.col("rank") <= F.coalesce("max_interpretations", F.lit(3)))
    best = best.select("qid", "fid", "rank", "score").join(rows, ["qid", "fid"])
    return display(cut(best, "ranked"), store).select("qid", "rank", "fid", "score", "name", "display_name", "highlighted_name")
