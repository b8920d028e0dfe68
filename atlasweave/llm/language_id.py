"""Language ID: averaged hashed subword embeddings with a linear softmax, trained by SGD, with calibrated rejection.

A text is the average of the embeddings of its hashed byte n-grams (after lower-casing A-Z), a linear layer and a
softmax give the languages. It is trained in NumPy by stochastic gradient descent with adaptive steps on a sample of at
most ``SAMPLE`` different documents a language (the only use of a sample; the smallest hashes of id and text). A part of the sample
is set aside: a temperature is fitted on it, and the threshold of rejection is the confidence that all but a share
``REJECT`` of its correctly predicted texts reach, at most 0.5. As all is linear before the softmax, embeddings times
layer is one table that workers sum over the n-grams of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave.llm._hashed import packed, softmax, sums, unpacked
from atlasweave.llm._spark import bounded, keep_ids, written
from atlasweave.llm._text import column_bytes, pieces

SAMPLE = 400  # documents a language
LANGUAGES = 1000  # more labels than this are an error
BITS, DIM, EPOCHS, RATE, REJECT = 15, 16, 6, 0.5, 0.002


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ids, counts = zip(*(packed(t.encode(), BITS, True) for t in b.column(2).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "ids", "counts"])


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> dict:
    """(lang, buckets, shares) to {langs, table, bias, threshold}."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return {"langs": [], "table": np.zeros((1 << BITS, 1), np.float32), "bias": np.zeros(1), "threshold": 0.0}
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(r[0]) for r in rows])
    aside = rng.random(len(rows)) < 0.2
    if len(set(y[~aside])) < len(langs):
        aside[:] = False
    e = rng.normal(0, 0.1, (1 << BITS, DIM)).astype(np.float32)
    w, bias = rng.normal(0, 0.1, (DIM, len(langs))), np.zeros(len(langs))
    ge, gw, gb = np.full(1 << BITS, 1e-8, np.float32), np.full(w.shape, 1e-8), np.full(bias.shape, 1e-8)
    train = np.flatnonzero(~aside)
    for _ in range(EPOCHS):
        for i in rng.permutation(train):
            _, at, share = rows[i]
            h = np.einsum("i,ij->j", share, e[at])
            g = softmax(h @ w + bias)
            g[y[i]] -= 1
            back = (w @ g).astype(np.float32)
            step = share[:, None] * back
            ge[at] += (step * step).sum(axis=1)
            e[at] -= RATE * 0.2 * step / np.sqrt(ge[at])[:, None]
            d = np.outer(h, g)
            gw += d * d
            w -= RATE * 0.2 * d / np.sqrt(gw)
            gb += g * g
            bias -= RATE * 0.05 * g / np.sqrt(gb)
    table = (e @ w).astype(np.float32)
    check = np.flatnonzero(aside) if aside.any() else train
    logits = np.stack([np.einsum("i,ij->j", rows[i][2], table[rows[i][1]]) + bias for i in check])
    heat = min(np.geomspace(0.5, 5, 40), key=lambda t: -np.log(np.maximum(softmax(logits / t)[np.arange(len(check)), y[check]], 1e-12)).mean())
    p = softmax(logits / heat)
    right = p.argmax(axis=1) == y[check]
    threshold = min(0.5, float(np.quantile(p.max(axis=1)[right], REJECT))) if right.any() else 0.0
    return {"langs": langs, "table": (table / heat).astype(np.float32), "bias": bias / heat, "threshold": threshold}


def train(docs: DataFrame) -> dict:
    """Fits on (doc_id, text, lang); null languages and texts aren't used."""
    key = ["doc_id", "lang", "h"]
    known = bounded(docs).where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "lang", "text", F.xxhash64("text").alias("h"))
    rows = written(known.select(*key), "known")
    at = F.xxhash64(*key)
    counts = written(rows.groupBy("lang").agg(F.approx_count_distinct(at).alias("n")), "languages")
    if (languages := counts.limit(LANGUAGES + 1).count()) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # rows of small hashes alone are ordered: about 4 * SAMPLE of a language, whatever its share of all rows is
    few = rows.join(F.broadcast(counts), "lang").where(F.pmod(at, F.lit(1 << 30)) * F.col("n").cast("double") < float(4 * SAMPLE << 30)).select(*key).distinct()
    order = W.partitionBy("lang").orderBy(at, "doc_id", "h")
    sample = written(few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= SAMPLE).select(*key), "sample")
    found = keep_ids(known, sample, key).dropDuplicates(key).limit(SAMPLE * max(1, languages)).select("doc_id", "lang", "text")
    found = found.mapInArrow(_examples, "doc_id long, lang string, ids binary, counts binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["lang"], r["ids"], r["counts"]))  # at most SAMPLE * LANGUAGES, of 2**BITS values
    return fit([(r["lang"], *unpacked(r["ids"], r["counts"])) for r in rows])


def predict(docs: DataFrame, model: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) to doc_id, lang_pred, score, accepted and the columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS values a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        letter = regex.compile(r"\p{L}").search
        m = shared.value
        for b in pieces(batches, 1):
            logits, n = sums(*column_bytes(b.column(1)), m["table"], BITS, True)
            p = softmax(logits / np.maximum(n, 1)[:, None] + m["bias"])
            has = np.array([bool(m["langs"]) and t is not None and letter(t) is not None for t in b.column(1).to_pylist()], bool)
            best = p.argmax(axis=1)
            score = np.where(has, p.max(axis=1), 0.0)
            pred = [m["langs"][k] if h else "und" for k, h in zip(best, has)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score), pa.array(has & (score >= m["threshold"])), *(b.column(b.schema.get_field_index(c)) for c in carry)], ["doc_id", "lang_pred", "score", "accepted", *carry])

    docs = bounded(docs).select("doc_id", "text", *(c for c in carry if c != "text"))
    return docs.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType()), *(docs.schema[c] for c in carry)]))


def language_ids(docs: DataFrame, fold: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted for every row.

    Learns only from text and language of documents whose crc32(id as text) modulo ``fold`` isn't ``held``. A null text or
    one without a letter is ``und`` with score 0 and isn't accepted; so is every text if nothing could be learned. Null ids
    aren't held out nor learned from. Rows that repeat are predicted alike; other columns are never read.
    """
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), rest.alias("held_out"))
    model = train(docs.where("NOT held_out"))
    out = predict(docs, model)
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    return out.select("doc_id", rest.alias("held_out"), "lang_pred", "score", "accepted")


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return language_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"))
