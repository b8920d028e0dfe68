"""Session helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a side table is broadcast after counting it.
BROADCAST_ROWS = 200_000

#: Bytes, reckoned from the rows and the types of their columns, up to which a step's table may be broadcast.
BROADCAST_BYTES = 16_000_000


def cut(df: DataFrame, what: str = "step") -> DataFrame:
    """The rows as a table in the shared folder (``spark.checkpoint.dir``), read again; a temporary one only if unset.

    Spark takes a table for as large as the read columns' share of its files, which can be a hundredth of its rows in memory,
    and would broadcast it by that. So its rows are counted, and a large one is joined by a shuffle.
    """
    spark = df.sparkSession
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="shared-")
            spark.sparkContext.setCheckpointDir(path)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    path = f"{path}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    n = out.count()
    return out.hint("merge") if n > BROADCAST_ROWS or n * df._jdf.schema().defaultSize() > BROADCAST_BYTES else out


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, if it has fewer: for rows that cost much more than their move."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def with_columns(df: DataFrame, options: dict[str, str]) -> DataFrame:
    """df with the given columns, null where it hasn't them."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in options.items() if c not in df.columns})


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; else as it is, to be joined by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
