"""A corpus pipeline of five stages over ``documents``; each works on all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasweave.llm import bpe, language_id, weak_quality
from atlasweave.llm._spark import drop_ids, keep_ids, written
from atlasweave.llm.decontamination import contaminated
from atlasweave.llm.jaccard_join import jaccard_components

#: SQL can express neither the trained models nor the similarity join; the tests compare run() with a brute-force version.
ORACLE_SQL = None


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rest): the other columns in one struct, so that no name can clash."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    fill = "#" * (1 + max(map(len, others), default=0))  # a struct needs a field, of a name that no column has
    rest = F.struct(F.lit(True).alias(fill), *(F.col(_quoted(c)) for c in others))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, decided row by row.

    Null, empty and wordless texts go; rows that repeat are decided alike; null ids and other columns, whatever their names
    are, stay as they are; an empty table stays empty.
    """
    rows = _packed(docs)
    scored = weak_quality.score(rows, *weak_quality.train(rows), carry=("text", "rest"))
    return _unpacked(scored.where("accepted"), docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; without any language to learn, all stay.

    Null texts and those without a letter go; rows that repeat are decided alike; null ids and other columns stay as they are.
    """
    rows = _packed(docs)
    known = F.col("rest").getField("lang") if "lang" in docs.columns else F.lit(None)
    model = language_id.train(rows.select("doc_id", "text", known.cast("string").alias("lang")))
    if not model["langs"]:
        return docs
    return _unpacked(language_id.predict(rows, model, carry=("text", "rest")).where("accepted"), docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id.

    Of rows that repeat an id, that with the smallest hash of its text stays, then by its other columns. Null ids, and null or
    empty texts of ids of their own, stay. An empty table stays empty.
    """
    found = written(jaccard_components(docs), "groups")
    out = drop_ids(docs, found.where("component_id != doc_id"), "doc_id")
    repeated = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if repeated.limit(1).count():
        order = F.struct(F.xxhash64("text"), "text", F.to_json(F.struct(*map(_quoted, docs.columns))))
        own = F.struct(*(F.col(_quoted(c)) for c in docs.columns))
        one = keep_ids(out, repeated, "doc_id").groupBy("doc_id").agg(F.min_by(own, order).alias("row"))
        one = one.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
        out = drop_ids(out, repeated, "doc_id").select(*map(_quoted, docs.columns)).union(one)
    return out.select(*map(_quoted, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even with its parameters replaced.

    Null ids, and null or empty texts, stay; all rows of an id go with one that holds an item; an empty benchmark keeps all.
    """
    leaks = written(contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id"), "leaks")
    return drop_ids(docs, leaks, "doc_id").select(*map(_quoted, docs.columns))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The byte-level BPE of what is left: doc_id, n_tokens and digests of ids and decoded bytes, a row for each row.

    A null text is encoded as an empty one.
    """
    return bpe.digests(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
