"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids is broadcast up to this many rows (a hashed relation of 16 bytes a row, 32 MB); beyond it a shuffled join is used.
BROADCAST_IDS = 2_000_000


#: Rows in an Arrow batch at most. A batch of whole texts is held several times over by a task and its worker.
BATCH_ROWS = 1000


def bounded(df: DataFrame) -> DataFrame:
    """df, after lowering the session's size of Arrow batches to BATCH_ROWS if it is larger."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by all machines: ``spark.checkpoint.dir``; only where it is unset (tests on one machine) a temporary one."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None and sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    if path is None:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = tempfile.mkdtemp(prefix="shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, read again: lineage is cut and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_mounted(spark: SparkSession) -> bool:
    """Whether the shared folder is on a mounted file system, so that workers can map its files."""
    return urlparse(shared_dir(spark)).scheme in ("", "file")


def posix_dir(spark: SparkSession, what: str) -> str:
    """A new folder for plain files in the shared folder, which must be mounted as a file system on every machine."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        raise ValueError(f"files to map into memory need spark.checkpoint.dir on a mounted file system, not {url.scheme}:")
    path = f"{url.path}/{what}-{uuid.uuid4().hex}"
    os.makedirs(path)
    return path


def keep_ids(df: DataFrame, ids: DataFrame, key: str | list[str], limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key is among ids: broadcast after counting the ids, or by a shuffled join beyond the limit."""
    key = [key] if isinstance(key, str) else key
    ids = ids.select(*key).dropna().distinct()
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, key: str, limit: int = BROADCAST_IDS) -> DataFrame:
    """Rows of df whose key isn't among ids (a null key stays)."""
    ids = ids.select(key).where(F.col(key).isNotNull()).distinct()
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return df.join(ids, key, "left_anti")


def join_sized(rows: DataFrame, classes: DataFrame, keys: list[str], how: str = "inner", size: str | None = "n", hot: int = 1000, limit: int = BROADCAST_IDS) -> DataFrame:
    """rows joined (inner or left) to classes, of which each key has one and ``size`` tells how many rows it has.

    Classes of more than ``hot`` rows, all if no size is given, are broadcast after they were counted, so that no task gets
    all rows of one; the others are joined by a shuffle, as are all beyond the limit.
    """
    big = classes if size is None else classes.where(F.col(size) > hot)
    n = big.limit(limit + 1).count()
    if n > limit or n == 0 and size is not None:
        return rows.join(classes, keys, how)
    if size is None:
        return rows.join(F.broadcast(big), keys, how)
    rest = rows.join(F.broadcast(big.select(*keys)), keys, "left_anti").join(classes.where(F.col(size) <= hot), keys, how)
    return rows.join(F.broadcast(big), keys).unionByName(rest)
