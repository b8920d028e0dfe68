"""Quality classifier: a weak-label model by expectation-maximisation, and a hashed linear scorer of its labels.

Seven overlapping heuristics look at the bytes of a whole text and vote good, bad or abstain. All documents are counted
by their pattern of votes (at most 3**7), and EM over these counts estimates each heuristic's accuracy for good and for
bad texts and the share of good ones, without any labels. The posterior of a document's pattern is its weak label.
A logistic scorer of hashed byte n-grams and hashed levels of the measures is then trained on the posteriors of a sample
of at most ``SAMPLE`` different documents of each side (the only use of a sample; smallest hashes of id and text). A document is
accepted if its score is ``ACCEPT`` or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave.llm._hashed import packed, sums, unpacked
from atlasweave.llm._spark import bounded, keep_ids, written
from atlasweave.llm._text import column_bytes, hash_words, mix, pieces

SAMPLE = 2000  # documents of each weak label
BITS, EPOCHS, RATE, ACCEPT = 15, 5, 0.3, 0.3
LEVELS = 16  # of each measure, as hashed features of the scorer

#: name: (bad from this value on, good up to this value or never); otherwise the heuristic abstains.
HEURISTICS = {
    "symbols": (0.03, -1),  # of #*$%&|<> in bytes
    "capitals": (0.4, 0.15),  # A-Z in ASCII letters
    "exclaimed": (0.3, -1),  # ! in words
    "repeated": (0.3, -1),  # words equal to the word before
    "few_pairs": (0.6, 0.35),  # word pairs that came before, in all pairs
    "piped": (0.1, -1),  # | in words
    "unlettered": (0.15, 0.08),  # of printing ASCII bytes that are no letters or digits, beyond the first four
}
NAMES = list(HEURISTICS)
_CLASS = np.zeros(256, np.uint8)  # 1 symbol, 2 capital, 4 small letter, 8 !, 16 |, 32 printing but no letter or digit
for _b in b"#*$%&|<>":
    _CLASS[_b] |= 1
_CLASS[65:91] |= 2
_CLASS[97:123] |= 4
_CLASS[ord("!")] |= 8
_CLASS[ord("|")] |= 16
for _b in range(33, 128):
    if not chr(_b).isalnum():
        _CLASS[_b] |= 32


def measures(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(rows, heuristics): the measures of each text; nan where there is too little text to tell."""
    size = np.diff(off)
    kind = _CLASS[buf]

    def total(bit: int) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum((kind & bit) > 0)])
        return c[off[1:]] - c[off[:-1]]

    words, at = hash_words(buf, off)
    n = np.diff(at)
    again = np.concatenate([[False], words[1:] == words[:-1]]) if len(words) else np.zeros(0, bool)
    again[at[:-1][n > 0]] = False
    c = np.concatenate([[0], np.cumsum(again)])
    repeats = c[at[1:]] - c[at[:-1]]
    pairs = np.full(len(n), np.nan)
    both = mix(words[:-1]) + words[1:] if len(words) > 1 else words[:0]
    for i in np.flatnonzero(n >= 20):
        pairs[i] = 1 - len(np.unique(both[at[i] : at[i + 1] - 1])) / (n[i] - 1)
    letters = total(2) + total(4)
    with np.errstate(invalid="ignore", divide="ignore"):
        out = np.stack([total(1) / size, np.where(letters >= 10, total(2) / letters, np.nan), total(8) / n, np.where(n >= 5, repeats / (n - 1), np.nan), pairs, total(16) / n, np.maximum(total(32) - 4, 0) / size], axis=1)
    out[n == 0] = np.nan
    return out


def votes(m: np.ndarray) -> np.ndarray:
    """2 good, 1 bad, 0 abstains."""
    bad, good = (np.array([HEURISTICS[k][i] for k in NAMES]) for i in (0, 1))
    with np.errstate(invalid="ignore"):
        return np.where(m >= bad, 1, np.where(m <= good, 2, 0))


def _pattern(v: np.ndarray) -> np.ndarray:
    return (v * 3 ** np.arange(v.shape[1])).sum(axis=1)


def expectation_maximisation(patterns: dict[int, int], rounds: int = 100) -> tuple[dict[int, float], dict]:
    """{pattern: documents} to the posterior of good of each pattern, and the accuracies."""
    codes = np.array(sorted(patterns), np.int64)
    n = np.array([patterns[c] for c in codes.tolist()], float)
    v = codes[:, None] // 3 ** np.arange(len(NAMES)) % 3
    # begins with: any bad vote tells bad
    post = np.where((v == 1).any(axis=1), 0.1, 0.9)
    rate = np.zeros((2, len(NAMES), 3))
    for _ in range(rounds):
        for side, p in enumerate((1 - post, post)):
            for vote in range(3):
                rate[side, :, vote] = ((n * p)[:, None] * (v == vote)).sum(axis=0)
            rate[side] += np.array([1.0, 1.0 + (side == 0), 1.0 + (side == 1)])  # a weak prior that votes are right
            rate[side] /= rate[side].sum(axis=1, keepdims=True)
        share = (1 + (n * post).sum()) / (2 + n.sum())
        # a heuristic that abstains adds nothing; a vote tells by how often each side gets it
        told = np.where(v > 0, np.log(rate[1][np.arange(len(NAMES)), v] / rate[0][np.arange(len(NAMES)), v]), 0).sum(axis=1)
        new = 1 / (1 + np.exp(-np.clip(np.log(share / (1 - share)) + told, -30, 30)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    right = {k: {"good": float(rate[1][i, 2] / rate[1][i, 1:].sum()), "bad": float(rate[0][i, 1] / rate[0][i, 1:].sum())} for i, k in enumerate(NAMES)}
    return dict(zip(codes.tolist(), post.tolist())), {"good_share": float(share), "accuracy": right}


def _levels(m: np.ndarray) -> np.ndarray:
    """Feature number of each measure's level (the last level: unknown)."""
    level = np.where(np.isnan(m), LEVELS - 1, np.minimum(np.nan_to_num(m) * 20, LEVELS - 2)).astype(int)
    return level + np.arange(m.shape[1]) * LEVELS


def _vote_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(_pattern(votes(measures(*column_bytes(b.column(1))))), pa.int64())], ["doc_id", "h", "pattern"])


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in pieces(batches, 1):
        m = measures(*column_bytes(b.column(1)))
        ids, counts = zip(*(packed((t or "").encode(), BITS, False) for t in b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_pattern(votes(m)), pa.int64()), pa.array([x.astype("<u2").tobytes() for x in _levels(m)], pa.binary()), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "pattern", "levels", "ids", "counts"])


def fit_scorer(rows: list[tuple[float, np.ndarray, np.ndarray, np.ndarray]], seed: int = 5) -> dict:
    """(posterior, levels, buckets, shares) to the weights of the logistic scorer."""
    w, lv, b = np.zeros(1 << BITS), np.zeros(len(NAMES) * LEVELS), 0.0
    gw, gl, gb = np.full(w.shape, 1e-8), np.full(lv.shape, 1e-8), 1e-8
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, levels, at, share = rows[i]
            g = 1 / (1 + np.exp(-np.clip((w[at] * share).sum() + lv[levels].sum() + b, -30, 30))) - y
            gw[at] += (g * share) ** 2
            w[at] -= RATE * 0.3 * g * share / np.sqrt(gw[at])
            gl[levels] += g * g
            lv[levels] -= RATE * g / np.sqrt(gl[levels])
            gb += g * g
            b -= RATE * g / np.sqrt(gb)
    return {"table": w.astype(np.float32)[:, None], "levels": lv, "bias": float(b)}


def _sampled(rows: DataFrame, at: Column) -> DataFrame:
    """(doc_id, h) of the SAMPLE different rows with the smallest hashes."""
    return rows.select("doc_id", "h").distinct().orderBy(at, "doc_id", "h").limit(SAMPLE)


def train(docs: DataFrame) -> tuple[dict, dict]:
    """Fits the weak-label model on all of (doc_id, text) and the scorer on its sample; returns scorer and weak model."""
    docs = bounded(docs).select("doc_id", "text", F.xxhash64("text").alias("h"))
    voted = written(docs.mapInArrow(_vote_rows, "doc_id long, h long, pattern long"), "votes")
    patterns = {r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return {"table": np.zeros((1 << BITS, 1), np.float32), "levels": np.zeros(len(NAMES) * LEVELS), "bias": 0.0}, {"good_share": 0.5, "accuracy": {}, "posterior": {}}
    post, weak = expectation_maximisation(patterns)
    bad = [p for p, x in post.items() if x < 0.5]
    known = voted.where("doc_id IS NOT NULL")
    at = F.xxhash64("doc_id", "h")
    side = lambda c: _sampled(known.where(c), at)
    sample = written(side(F.col("pattern").isin(bad)).union(side(~F.col("pattern").isin(bad))), "sample")
    found = keep_ids(docs.where("doc_id IS NOT NULL"), sample, ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).limit(2 * SAMPLE)
    found = found.select("doc_id", "text").mapInArrow(_examples, "doc_id long, pattern long, levels binary, ids binary, counts binary")
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"], r["pattern"], r["ids"], r["counts"]))  # at most 2 * SAMPLE, of 2**BITS values
    scorer = fit_scorer([(post[r["pattern"]], np.frombuffer(r["levels"], "<u2"), *unpacked(r["ids"], r["counts"])) for r in rows])
    return scorer, weak | {"posterior": post}


def score(docs: DataFrame, scorer: dict, weak: dict, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) to doc_id, weak_label, quality, accepted and the columns to carry along."""
    shared = docs.sparkSession.sparkContext.broadcast((scorer, weak["posterior"]))  # 2**BITS weights and at most 3**7 patterns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, post = shared.value
        for b in pieces(batches, 1):
            buf, off = column_bytes(b.column(1))
            m = measures(buf, off)
            total, n = sums(buf, off, s["table"], BITS, False)
            x = total[:, 0] / np.maximum(n, 1) + s["levels"][_levels(m)].sum(axis=1) + s["bias"]
            q = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            empty = np.isnan(m).all(axis=1)
            q[empty] = 0.0
            weak_label = [post.get(p, 0.5) for p in _pattern(votes(m)).tolist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weak_label, pa.float64()), pa.array(q), pa.array((q >= ACCEPT) & ~empty), *(b.column(b.schema.get_field_index(c)) for c in carry)], ["doc_id", "weak_label", "quality", "accepted", *carry])

    docs = bounded(docs).select("doc_id", "text", *(c for c in carry if c != "text"))
    return docs.mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("weak_label", T.DoubleType()), T.StructField("quality", T.DoubleType()), T.StructField("accepted", T.BooleanType()), *(docs.schema[c] for c in carry)]))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, weak_label (posterior of the weak-label model), quality (the scorer's), accepted, for every row.

    Null, empty and wordless texts have quality 0 and aren't accepted. Null ids are scored but not trained on; rows that
    repeat score alike; other columns are ignored; an empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score(docs, *train(docs))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
