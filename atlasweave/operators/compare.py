"""Comparing sets and rankings: what is missing, notable or ambiguous, and how two rankings differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def best_of_each(rows: DataFrame, request: str, place: str, order: list, then: list, most: int | None = None) -> DataFrame:
    """Of the interpretations of a request with one primary place the first by ``order``, ranked by ``then``, at most ``most``."""
    own = rows.withColumn("#", F.row_number().over(W.partitionBy(request, place).orderBy(*order))).where("`#` = 1").drop("#")
    ranked = own.withColumn("rank", F.row_number().over(W.partitionBy(request).orderBy(*then)))
    return ranked.where(F.col("rank") <= most) if most else ranked


def ambiguous(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share all keys with others, and how many do. The groups are counted first, so no task gets a whole group."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(counts, keys)


def notable(rows: DataFrame, marks: DataFrame, on: Column) -> DataFrame:
    """Rows that a table of marks has."""
    return rows.join(marks, on, "left_semi")


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys that are wanted, each once, but not in hand."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def top_of(rows: DataFrame, request: str, place: str, value: str, name: str) -> DataFrame:
    """(request, name): the place of the largest value, ties to the larger place; a null value isn't ranked."""
    return rows.where(F.col(value).isNotNull()).groupBy(request).agg(F.max_by(place, F.struct(value, place)).alias(name))


def outcomes(old: DataFrame, new: DataFrame, request: str) -> DataFrame:
    """(outcome, n, pairs) of two answers (request, old) and (request, new): how many requests each outcome has, and how many
    different pairs of answers are behind it."""
    both = old.join(new, request, "full_outer")
    kind = F.when(F.col("old").isNull(), "geocoded more").when(F.col("new").isNull(), "geocoded less").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return both.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("old", "new").alias("pairs"))


def unsigned_order(cell: Column) -> list[Column]:
    """Sort keys that put signed 64-bit keys into unsigned order."""
    return [cell < 0, cell]


def ordered_keys(rows: DataFrame, by: str, cell: str) -> DataFrame:
    """(by, n, cell): different keys in unsigned order within their group."""
    return rows.select(by, cell).distinct().withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*unsigned_order(F.col(cell))))).select(by, "n", cell)
