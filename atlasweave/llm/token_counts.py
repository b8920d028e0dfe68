"""Token counts: a separator scan over flat token files that have no index.

A token file is a bare sequence of little-endian ids, each document followed by the end-of-document id. The files are
cut into blocks of a fixed number of ids. Each block is searched for the separator in one vectorised comparison of
mapped memory and gives one row: the ids before its first separator, the lengths between its separators and the ids
after its last. A prefix scan over a file's blocks carries open lengths and document numbers from block to block, so a
document may span any number of blocks and a block may hold any number of documents.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasweave.llm._spark import posix_dir, written
from atlasweave.llm.bpe import encode, share

BLOCK = 1 << 20  # ids in a block


def width_of(vocabulary: int, eod: int) -> str:
    """The narrowest type of ids that holds a vocabulary and its separator."""
    return "<u2" if max(vocabulary, eod + 1) <= 1 << 16 else "<u4"


def write_token_files(encoded: DataFrame, folder: str, eod: int, dtype: str = "<u2") -> DataFrame:
    """Writes (doc_id, ids) as one flat file per task into a mounted folder; returns (file, ordinal, doc_id).

    An id that doesn't fit the type, or a text that holds the separator, is an error.

    A file appears under its name only when whole, so a task that is run again replaces it by the same bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{TaskContext.get().partitionId():06d}.tokens"
        own, at = f"{folder}/.{uuid.uuid4().hex}", 0
        end = np.array([eod], dtype).tobytes()
        with open(own, "wb") as out:
            for b in batches:
                ids, off = b.column(1).values.to_numpy(), np.asarray(b.column(1).offsets)
                flat = ids.astype(dtype)
                if (flat != ids).any() or (flat[off[0] : off[-1]] == eod).any():
                    raise ValueError("an id doesn't fit the token files, or is the separator")
                for i in range(b.num_rows):
                    out.write(flat[off[i] : off[i + 1]].tobytes())
                    out.write(end)
                yield pa.RecordBatch.from_arrays([pa.array([name] * b.num_rows), pa.array(np.arange(at, at + b.num_rows)), b.column(0)], ["file", "ordinal", "doc_id"])
                at += b.num_rows
        os.replace(own, f"{folder}/{name}")

    return written(encoded.select("doc_id", "ids").mapInArrow(run, "file string, ordinal long, doc_id long"), "token-index")


def _scan(folder: str, eod: int, dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for name, block, lo, hi in zip(*(c.to_pylist() for c in b.columns)):
                ids = np.memmap(f"{folder}/{name}", dtype, "r", lo * np.dtype(dtype).itemsize, (hi - lo,))
                at = np.flatnonzero(ids == eod)
                if len(at):
                    rows.append((name, block, len(at), int(at[0]), np.diff(at) - 1, hi - lo - int(at[-1]) - 1))
                else:
                    rows.append((name, block, 0, 0, np.zeros(0, int), hi - lo))
            file, block, n, head, inner, tail = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(file), pa.array(block, pa.int64()), pa.array(n, pa.int64()), pa.array(head, pa.int64()), pa.array([x.tolist() for x in inner], pa.list_(pa.int64())), pa.array(tail, pa.int64())], ["file", "block", "n", "head", "inner", "tail"])

    return run


def count_tokens(spark: SparkSession, folder: str, eod: int, dtype: str = "<u2", block: int = BLOCK) -> DataFrame:
    """(file, ordinal, n_tokens, complete) of every document in the token files of a mounted folder.

    A run of separators gives empty documents of 0 tokens; ids after the last separator of a file are one document that
    isn't complete; an empty file has none.
    """
    width = np.dtype(dtype).itemsize
    files = [(x.name, x.stat().st_size // width) for x in os.scandir(folder) if x.name.endswith(".tokens")]
    blocks = spark.createDataFrame(files, "file string, n long").where("n > 0")
    blocks = blocks.select("file", F.posexplode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("block", "lo"), "n")
    blocks = blocks.select("file", F.col("block").cast("long").alias("block"), "lo", F.least(F.col("lo") + block, "n").alias("hi"))
    blocks = blocks.repartition(2 * spark.sparkContext.defaultParallelism, "file", "block")
    found = blocks.mapInArrow(_scan(folder, eod, dtype), "file string, block long, n long, head long, inner array<long>, tail long")
    # prefix scan: which block held the last separator, what has been open since, how many documents ended before
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("ended", F.coalesce(F.sum("n").over(before), F.lit(0)))
    run = W.partitionBy("file", "since").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    found = found.withColumn("since", F.coalesce(F.sum((F.col("n") > 0).cast("long")).over(before), F.lit(0)))
    # the block that ends a run of open blocks belongs to the same run; the tail of the block that began it comes first
    opened = F.coalesce(F.sum("tail").over(run), F.lit(0))
    first_tail = F.coalesce(F.max(F.when(F.col("n") > 0, F.struct("block", "tail"))).over(before)["tail"], F.lit(0))
    found = found.withColumn("carry", opened + first_tail)
    whole = F.when(F.col("n") > 0, F.concat(F.array(F.col("carry") + F.col("head")), "inner")).otherwise(F.array().cast("array<long>"))
    done = found.select("file", "ended", F.posexplode(whole).alias("pos", "n_tokens")).select("file", (F.col("ended") + F.col("pos")).alias("ordinal"), "n_tokens", F.lit(True).alias("complete"))
    last = found.groupBy("file").agg(F.max_by(F.struct((F.col("ended") + F.col("n")).alias("ordinal"), F.when(F.col("n") > 0, F.col("tail")).otherwise(F.col("carry") + F.col("tail")).alias("n_tokens")), "block").alias("x"))
    rest = last.select("file", "x.ordinal", "x.n_tokens", F.lit(False).alias("complete")).where("n_tokens > 0")
    return done.unionByName(rest)


def document_token_counts(docs: DataFrame, vocabulary: str | None = None, eod: int = 50256, block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, complete: documents are encoded to flat files in the shared folder, then counted by the scan.

    Null and empty texts count 0; rows that repeat count each; a null id stays null; no documents give no rows.
    """
    import public_tokenizers

    spark = docs.sparkSession
    shared = share(spark, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    dtype = width_of(len(shared.value[1]), eod)
    folder = posix_dir(spark, "tokens")
    index = write_token_files(encode(docs, shared), folder, eod, dtype)
    # merged by a shuffle: Parquet packs the index so well that its size on disk would pass for one to broadcast
    return index.hint("merge").join(count_tokens(spark, folder, eod, dtype, block), ["file", "ordinal"]).select("doc_id", "n_tokens", "complete")


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every document, counted in flat token files by their separators."""
    return document_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
