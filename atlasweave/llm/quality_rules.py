"""Quality rules: a hashed n-gram log-likelihood ratio of two multinomials, in DataFrame expressions only.

Each word gives three features: itself, its last three characters, and the pair with the next word. Features are hashed to
``BUCKETS`` buckets. One pass counts the buckets in all documents (raw) and in the trusted target, the documents with a
label of quality 1 that aren't toxic; counting is combined in the tasks, so what is shuffled is at most a row per bucket
and task. The target's multinomial is smoothed towards the raw one with the mass of ``PRIOR`` features, so where the
target says little the ratio is 0. A document's score is the mean log ratio of its features. It is kept if it passes the
base rules and its score is ``THRESHOLD`` or more; every document is decided alike, with no sampling.

The ratios are ``BUCKETS`` numbers, so they go to the driver and back to the tasks as one constant array. Per-document work stays in one
row: arrays are bound by ``_let`` so that no lambda computes an array anew for each element.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import BROADCAST_IDS

BUCKETS = 1 << 14
PRIOR = 50_000.0
THRESHOLD = -0.25
WINDOW = 8
BLANK = r"[\x20\x09-\x0D]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null is empty."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def _features(words: Column) -> Column:
    """Buckets of the words, their endings and their pairs."""
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS)).cast("int")
    return F.concat(
        F.transform(words, lambda w: bucket(F.xxhash64(w))),
        F.transform(words, lambda w: bucket(F.xxhash64(F.lit("-"), F.right(w, F.lit(3))))),
        _let(words, lambda a: F.filter(F.transform(a, lambda w, i: F.when(i + 1 < F.size(a), bucket(F.xxhash64(w, F.get(a, i + 1))))), lambda b: b.isNotNull())),
    )


def _repeated(hashes: Column) -> Column:
    """How many words lie in windows of WINDOW words that the text holds twice or more, from the words' hashes."""

    def covered(s: Column) -> Column:
        twice = F.transform(s, lambda x, k: F.when(F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"]), x["i"]))
        return _let(F.array_sort(F.filter(twice, lambda i: i.isNotNull())), lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0).cast("long"), lambda a, x: a + x))

    def of(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), covered))

    windows = _let(hashes, lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(a, i, WINDOW))))
    return F.when(F.size(hashes) < WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, of))


def ratios(docs: DataFrame, labels: DataFrame) -> list[float]:
    """The log ratio of each bucket, rounded to 6 places; the length is always BUCKETS."""
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("trusted", F.lit(1))
    if trusted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    marked = docs.select("doc_id", "text").join(trusted, "doc_id", "left")
    each = marked.select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words_of(F.col("text")).alias("words")).select("trusted", F.explode(_features(F.col("words"))).alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # at most BUCKETS
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n, m = sum(raw), sum(target)
    p = [(x + 1.0) / (n + BUCKETS) for x in raw]
    return [round(math.log((x + PRIOR * q) / (m + PRIOR) / q), 6) for x, q in zip(target, p)]


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row.

    Null and empty texts have counts of 0, score 0 and fail the base rules. Labels may be empty, null or repeat; without a
    trusted document all scores are 0. Null ids are decided like others; rows that repeat count each; other columns of
    either table are ignored. Windows and words are told apart by 64-bit hashes within one text.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = F.split(F.lit(",".join(map(str, ratios(docs, labels)))), ",").cast("array<double>")  # folded to a constant
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.select(
        "doc_id",
        F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        _let(words_of(F.col("text")), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            _let(F.transform(w, lambda x: F.xxhash64(x)), _repeated).alias("n_repeat_words"),
            _let(_features(w), lambda f: F.when(F.size(f) == 0, F.lit(0.0)).otherwise(F.aggregate(f, F.lit(0.0), lambda a, b: a + F.get(table, b)) / F.size(f))).alias("score"),
        )).alias("w"),
    )
    rows = rows.select("doc_id", "w.n_words", "word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words", "w.score")
    failed = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Base rules and the hashed likelihood ratio for every document; the target is given by the labels."""
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
