"""Writers of indexes and replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_index(df: DataFrame, path: str, key: str, replace: bool = False, meta: dict | None = None) -> None:
    """An index as Parquet, ranged and sorted by key so that a reader's filter meets few row groups; without ``replace`` an
    existing one stays. ``meta`` is written beside it."""
    key_order = F.encode(F.col(key), "UTF-8") if dict(df.dtypes)[key] == "string" else F.col(key)
    df.withColumn("#", key_order).repartitionByRange("#").sortWithinPartitions("#").drop("#").write.mode("overwrite" if replace else "ignore").parquet(path)
    if meta:
        df.sparkSession.createDataFrame([(k, str(v)) for k, v in meta.items()], "key string, value string").coalesce(1).write.mode("overwrite" if replace else "ignore").parquet(f"{path}_meta")


def write_slugs(df: DataFrame, path: str) -> None:
    """slug, id, score, deprecated by tab, sorted by slug."""
    df.select("slug", "fid", "score", "deprecated").orderBy("slug").write.mode("overwrite").option("sep", "\t").csv(path)


def append_matches(df: DataFrame, path: str) -> None:
    """(id, fids) of matched polygons, appended by tab."""
    df.select("id", F.array_join(F.transform("fids", lambda x: x.cast("string")), ",").alias("fids")).write.mode("append").option("sep", "\t").csv(path)


def to_json(df: DataFrame, ids: list[str], callback: str | None = None) -> DataFrame:
    """One JSON text a row; 64-bit ids are strings, for readers with doubles only. ``callback`` wraps it as a script."""
    row = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) if c in ids else F.col(c) for c in df.columns)))
    return df.select((F.concat(F.lit(f"{callback}("), row, F.lit(")")) if callback else row).alias("json"))
