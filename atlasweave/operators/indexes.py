"""The read-only lookup tables: names, prefixes, ids and slugs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions.names import normalize, prefixes
from atlasweave.session import cut, small

LONGEST_HEAD = 5  # characters of a prefix that names are looked up by


def name_rows(names: DataFrame, features: DataFrame) -> DataFrame:
    """Distinct (name, fid, score) of normal names; the score is population plus boost."""
    keyed = names.select("fid", normalize(F.col("name")).alias("name")).where("name <> ''").distinct()
    return keyed.join(features.select("fid", (F.col("population") + F.col("boost")).alias("score")), "fid")


def name_index(names: DataFrame, features: DataFrame) -> DataFrame:
    """(name, fids): the places of each normal name, the most important first, ties by id."""
    return name_rows(names, features).groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("fid").alias("fid")))), lambda x: x["fid"]).alias("fids"))


def excluded_from_prefixes(name, flags, woe):
    """Names that match only whole: never displayed, of low quality, or all digits (but for postal codes)."""
    return (flags.bitwiseAND(F.lit(S.NEVER_DISPLAY | S.LOW_QUALITY)) != 0) | (name.rlike("^[0-9]+$") & (woe != S.POSTAL_CODE))


def prefix_index(names: DataFrame, features: DataFrame, longest: int = 5, scan: int = 1000, keep: int = 50, few: int = 3) -> DataFrame:
    """(prefix, rank, fid): up to ``keep`` places of each prefix of 1 to ``longest`` characters.

    Whole names first, then by importance and id; of the best ``scan``, preferred names in English or a local language
    come first, others only where there are fewer than ``few`` of these. Prefixes of one or two characters need a score
    over 0 unless they are the whole name.
    """
    at = features.select("fid", "woe", (F.col("population") + F.col("boost")).alias("score"))
    rows = names.select("fid", normalize(F.col("name")).alias("name"), "lang", "flags").where("name <> ''").join(at, "fid").where(F.col("woe").isin(S.TOWN, S.COUNTRY, S.ADMIN1, S.ADMIN2, S.ADMIN3, S.SUBURB, S.POSTAL_CODE, S.ISLAND, S.CONTINENT, S.AIRPORT, S.PARK))
    whole = F.col("name") == F.col("prefix")
    rows = rows.withColumn("prefix", F.explode(prefixes(F.col("name"), longest))).where(whole | ~excluded_from_prefixes(F.col("name"), F.col("flags"), F.col("woe"))).where(whole | (F.length("prefix") > 2) | (F.col("score") > 0))
    good = F.col("flags").bitwiseAND(F.lit(S.PREFERRED | S.ALT_NAME)) != 0
    near = (F.col("lang") == "en") | (F.col("flags").bitwiseAND(F.lit(S.LOCAL_LANG)) != 0)
    per = rows.groupBy("prefix", "fid").agg(F.min((~whole).cast("int")).alias("part"), F.max("score").alias("score"), F.min(F.when(good & near, 0).when(near, 1).otherwise(2)).alias("tier"))
    best = per.withColumn("n", F.row_number().over(W.partitionBy("prefix").orderBy("part", F.desc("score"), "fid"))).where(F.col("n") <= scan)
    best = best.withColumn("preferred", F.sum((F.col("tier") == 0).cast("int")).over(W.partitionBy("prefix"))).where((F.col("tier") == 0) | (F.col("preferred") < few))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy("tier", "n"))).where(F.col("rank") <= keep).select("prefix", "rank", "fid")


def prefix_lookup(queries: DataFrame, rows: DataFrame, most: int = 2500) -> DataFrame:
    """(qid, prefix) against (name, fid, score): places of all names that begin with the prefix.

    If there are over ``most``, each of n names gives its best most/n places (at least one) if n is at most ten times
    ``most`` and none otherwise; a prefix under three characters meets only names at most twice as long. At most ``most``.
    """
    asked = queries.where("prefix <> ''").select("qid", "prefix")
    different = cut(asked.select("prefix", F.least(F.lit(LONGEST_HEAD), F.length("prefix")).alias("size")).distinct().withColumn("head", F.expr("left(prefix, size)")), "prefixes")
    sizes = [r["size"] for r in different.select("size").distinct().collect()] or [1]  # at most LONGEST_HEAD
    # names that begin like a prefix, each once, to find out how many places there are before any is fetched
    sized = F.filter(F.array(*map(F.lit, sorted(sizes))), lambda n: n <= F.length("name"))
    named = rows.groupBy("name").agg(F.count("*").alias("n")).withColumn("size", F.explode(sized)).withColumn("head", F.expr("left(name, size)"))
    fits = F.col("name").startswith(F.col("prefix")) & ((F.length("prefix") >= 3) | (2 * F.length("prefix") >= F.length("name")))
    named = cut(named.join(small(different), ["size", "head"]).where(fits).select("prefix", "name", "n"), "named")
    totals = named.groupBy("prefix").agg(F.sum("n").alias("total"), F.count("*").alias("names")).where((F.col("total") <= most) | (F.col("names") <= 10 * most))
    hit = rows.join(named.join(totals, "prefix").drop("n"), "name").select("prefix", "name", "fid", "score", "total", "names")
    first = F.row_number().over(W.partitionBy("prefix", "name").orderBy(F.desc("score"), "fid"))
    each = F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("names"))).cast("int")
    hit = hit.withColumn("first", first).where((F.col("total") <= most) | (F.col("first") <= each))
    hit = hit.withColumn("n", F.row_number().over(W.partitionBy("prefix").orderBy("name", F.desc("score"), "fid"))).where(F.col("n") <= most)
    return asked.join(hit.select("prefix", "name", "fid"), "prefix").select("qid", "name", "fid")


def id_mapping(features: DataFrame, slugs: DataFrame, others: DataFrame) -> DataFrame:
    """(key, fid): slugs and alternate ids (as text) to places; the smallest id wins, the own id isn't mapped."""
    keys = slugs.select(F.col("slug").alias("key"), "fid").unionByName(others.where("other <> fid").select(F.col("other").cast("string").alias("key"), "fid"))
    return keys.join(features.select("fid"), "fid", "left_semi").groupBy("key").agg(F.min("fid").alias("fid"))


def resolve(keys: DataFrame, mapping: DataFrame, parsed) -> DataFrame:
    """(qid, key) to fid: by the mapping first, else the key read as an id by the given expression."""
    return keys.join(mapping, "key", "left").select("qid", "key", F.coalesce("fid", parsed).alias("fid"))


def slug_eligible(features: DataFrame) -> DataFrame:
    """Places that get slugs: populous, boosted, with a polygon, or of a type above the town."""
    return features.where((F.col("population") > 0) | (F.col("boost") > 0) | F.col("has_poly") | F.col("woe").isin(S.COUNTRY, S.ADMIN1, S.ADMIN2, S.ADMIN3))


def assign_slugs(candidates: DataFrame, permanent: DataFrame | None = None) -> DataFrame:
    """(fid, option, slug, score): each place takes the first of its options that no better place takes.

    Slugs of ``permanent`` (slug, fid) stay with their places, which get no other. In a round every place without a slug asks for
    its next option; of those who ask for one slug the best score keeps it, ties to the smaller id, and a holder with a lower
    score is put out and asks for its next in the following round. A place whose options are all taken gets its last
    one with the first free number from 2 on. Rounds go on until nobody is put out, so every place has a slug; as each
    moves only down its own list, they end.
    """
    options = candidates.select("fid", F.col("option").cast("bigint").alias("option"), "slug", F.col("score").cast("bigint").alias("score"))
    if permanent is not None:
        held = permanent.groupBy("slug").agg(F.min("fid").alias("fid"))
        options = options.join(held.select("fid"), "fid", "left_anti").join(held.select("slug"), "slug", "left_anti").unionByName(held.select("fid", F.lit(0).cast("bigint").alias("option"), "slug", F.lit((1 << 63) - 1).alias("score")))
        lost = candidates.select("fid", "score", "option", "slug").join(held.select("fid"), "fid", "left_anti")
    else:
        lost = candidates
    options = cut(options, "options")
    last = cut(lost.groupBy("fid").agg(F.max("score").cast("bigint").alias("score"), F.max_by("slug", "option").alias("base"), F.max("option").cast("bigint").alias("most")), "last")
    state = options.groupBy("fid").agg(F.min(F.struct("option", "slug", "score")).alias("x")).select("fid", "x.*")
    if permanent is not None:  # all options of a place were held by others
        state = state.unionByName(last.join(state.select("fid"), "fid", "left_anti").select("fid", (F.col("most") + 1).alias("option"), F.concat("base", F.lit("-2")).alias("slug"), "score"))
    state = cut(state, "slugs")
    while True:
        rank = F.row_number().over(W.partitionBy("slug").orderBy(F.desc("score"), "fid"))
        judged = cut(state.withColumn("n", rank), "slugs")
        lost = judged.where("n > 1")
        if not lost.limit(1).count():
            return judged.select("fid", "slug")
        was = lost.select("fid", F.col("option").alias("was"))
        following = was.join(options, "fid").where("option > was").groupBy("fid").agg(F.min(F.struct("option", "slug", "score")).alias("x")).select("fid", "x.*")
        numbered = was.join(following.select("fid"), "fid", "left_anti").join(last, "fid").select("fid", (F.greatest("was", "most") + 1).alias("option"), F.concat("base", F.lit("-"), (F.greatest("was", "most") - F.col("most") + 2).cast("string")).alias("slug"), "score")
        state = judged.where("n = 1").select("fid", "option", "slug", "score").unionByName(following).unionByName(numbered)


def round_robin(rows: DataFrame, by: str, order: list, most: int) -> DataFrame:
    """The first ``most`` rows, one of each group in turn."""
    n = F.row_number().over(W.partitionBy(by).orderBy(*order))
    return rows.withColumn("#", n).orderBy("#", by).limit(most).drop("#")
