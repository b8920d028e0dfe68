"""Hotfixes as a stream of JSON edit files: each new file updates the overlay of a store."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasweave.functions.names import normalize, prefixes
from atlasweave.operators.enrich import apply_edits, overlay
from atlasweave.operators.indexes import name_index, prefix_index
from atlasweave.plans.geocode import Store

_LONGS = "array<struct<kind:string,value:bigint>>"
#: Edits have these fields; one that is null changes nothing.
EDITS = f"fid bigint, seq bigint, kind string, population bigint, lat double, lng double, cc string, woe int, boost bigint, can_geocode boolean, parents_edits {_LONGS}, extras_edits {_LONGS}"


def edit_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Edits of the JSON line files that appear in a folder."""
    return spark.readStream.schema(EDITS).option("maxFilesPerTrigger", files_per_trigger).json(path)


def changes(base: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(changed, deleted) features of a store by edits: modified ones, added ones as bare places, removed ones."""
    touched = base.join(edits.select("fid").distinct(), "fid", "left_semi")
    changed = apply_edits(touched, edits)
    new = edits.where("kind = 'Add'").join(base.select("fid"), "fid", "left_anti").groupBy("fid").agg(F.max_by("population", "seq").alias("population"), F.max_by("lat", "seq").alias("lat"), F.max_by("lng", "seq").alias("lng"), F.max_by("cc", "seq").alias("cc"))
    made = new.select("fid", *(F.coalesce(F.col(c), F.lit(0).cast(t)).alias(c) if c in ("lat", "lng", "population") else F.coalesce("cc", F.lit("")).alias(c) if c == "cc" else F.lit(None).cast(t).alias(c) for c, t in base.dtypes if c != "fid"))
    return changed.unionByName(made), edits.where("kind = 'Remove'").select("fid").distinct()


def index_deltas(store: Store, after: Store, changed: DataFrame, deleted: DataFrame) -> dict[str, tuple[DataFrame, DataFrame]]:
    """(rows that go, rows that come) of the name and prefix indexes when the places of two tables of ids changed.

    Names and prefixes are rebuilt for those alone that a changed place has or had; all others stay as they are.
    """
    ids = changed.select("fid").union(deleted.select("fid")).distinct()
    of = lambda s: normalized(s.names.join(ids, "fid", "left_semi"))
    touched = of(store).union(of(after)).distinct()
    out = {}
    for name, key, make in (("names", "name", name_index), ("prefixes", "prefix", prefix_index)):
        keys = touched if key == "name" else touched.select(F.explode(prefixes(F.col("name"))).alias("prefix")).distinct()
        own = lambda s, keys=keys, key=key, make=make: make(_names_of(s, keys, key), s.features).join(keys, key, "left_semi")
        out[name] = own(store), own(after)
    return out


def normalized(names: DataFrame) -> DataFrame:
    return names.select(normalize(F.col("name")).alias("name")).where("name <> ''").distinct()


def _names_of(store: Store, keys: DataFrame, key: str) -> DataFrame:
    """Names of the store that are keys, or begin with them."""
    rows = store.names.withColumn("#", normalize(F.col("name")))
    rows = rows.withColumn("#", F.explode(prefixes(F.col("#")))) if key == "prefix" else rows
    return rows.join(keys.withColumnRenamed(key, "#"), "#", "left_semi").drop("#").distinct()


def start(edits: DataFrame, base: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False):
    """Starts the stream; after each batch ``publish(features, batch)`` gets the whole overlaid table.

    What is kept beside the checkpoint is the overlay itself, changed places and ids of deleted ones, a folder a batch: a batch
    reads that of the batch before and its own edits alone, and one that runs again replaces its own.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = lambda what, n: f"{checkpoint}/{what}/{n:09d}"
        if number:
            changed, deleted = spark.read.schema(base.schema).parquet(at("changed", number - 1)), spark.read.schema("fid bigint").parquet(at("deleted", number - 1))
        else:
            changed, deleted = base.limit(0), base.select("fid").limit(0)
        more, gone = changes(overlay(base, changed, deleted), batch)
        more = more.join(gone, "fid", "left_anti").select(*base.columns)
        ids = more.select("fid").union(gone)
        changed.join(ids, "fid", "left_anti").select(*base.columns).unionByName(more).write.mode("overwrite").parquet(at("changed", number))
        changed = spark.read.schema(base.schema).parquet(at("changed", number))
        deleted.union(gone).distinct().join(changed.select("fid"), "fid", "left_anti").write.mode("overwrite").parquet(at("deleted", number))
        publish(overlay(base, changed, spark.read.schema("fid bigint").parquet(at("deleted", number))), number)

    writer = edits.writeStream.foreachBatch(each).option("checkpointLocation", f"{checkpoint}/state")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
