"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, mapped into memory by the workers.

Counting never moves a row per token. A task sorts what it has counted and sends compressed blocks (sorted keys as
differences, and counts) to the shard of the keys; a shard merges its blocks and writes plain sorted arrays to the
shared folder:

* words: 64-bit hashes, sorted over all shards, with counts. A word's number is its rank plus 1; 0 is the boundary
  (start as a context, end as a token).
* bigrams: ``context << 32 | word``, sorted in each shard, with counts. A shard holds whole contexts; only contexts with
  more tokens than a quarter of a shard are dealt over all shards.
* for each word number: how many bigrams it begins that were seen once, twice, more often, and how many different
  contexts it follows.

Scoring maps the arrays read-only, so all workers of a machine share one copy in the page cache and read only the pages
they need. All counts cover the whole training part; nothing is pruned. Losing an executor repeats tasks, which replace
their files by equal ones. What the writers report tells how long each file must be; a file that isn't there whole is an
error. The vocabulary may have up to 2**32 - 2 words. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import bounded, posix_dir
from atlasweave.llm._packed import BLOCK, HELD, block_rows, blocks, mapped, merged, pack, save, summed
from atlasweave.llm._text import column_bytes, hash_words, mix, pieces

SHARD = 2_000_000  # tokens a shard of bigrams is made for
RANGE = 1 << 18  # word numbers in one part of the dense arrays, made by one task
_LOW = np.uint64(0xFFFFFFFF)


def _words_of(bits: int):
    """(doc_id, text) to blocks of word counts by the leading bits of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, counts, size, docs = [], [], 0, 0

        def flush():
            k, c = summed(np.concatenate(held), np.concatenate(counts))
            return block_rows(list(blocks(k, c, (k >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(k), int))))

        for b in pieces(batches, 1):
            w, _ = hash_words(*column_bytes(b.column(1)))
            k, c = np.unique(w, return_counts=True)
            held.append(k)
            counts.append(c)
            size += len(k)
            docs += b.num_rows
            if size > HELD:
                yield flush()
                held, counts, size = [], [], 0
        if held:
            yield flush()
        if docs:
            yield block_rows([(0, 1, pack(np.zeros(1, np.uint64), np.array([docs])))])

    return run


def _save_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, kind, keys, counts in merged(batches):
            if kind == 0:
                save(folder, f"word.{s}", keys)
                save(folder, f"word-count.{s}", counts.astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (s, kind, len(keys), int(counts.sum()))], ["shard", "kind", "types", "tokens"])

    return run


class Model:
    """The arrays of a folder, mapped; ``head`` holds what the driver knows: shard sizes, totals and discounts."""

    def __init__(self, folder: str, head: dict):
        self.folder, self.head, self.maps = folder, head, {}
        self.first = np.array(head["first"], np.int64)  # number of the first word of each shard
        self.hot = np.array(sorted(head.get("hot", ())), np.int64)

    def map(self, kind: str, part: int, dtype, n: int) -> np.ndarray:
        """The n values of a part of the model."""
        if (kind, part) not in self.maps:
            self.maps[kind, part] = mapped(self.folder, f"{kind}.{part}", dtype, n) if n else np.zeros(0, dtype)
        return self.maps[kind, part]

    def numbers(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sorted distinct hashes: word numbers (-1: not known) and counts."""
        out, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), np.int64)
        bits = self.head["bits"]
        shards, cut = np.unique(words >> np.uint64(64 - bits), return_index=True)
        for s, lo, hi in zip(shards.tolist(), cut, [*cut[1:], len(words)]):
            n = self.head["types"][s]
            if n:
                own, table = words[lo:hi], self.map("word", s, np.uint64, n)
                at = np.minimum(np.searchsorted(table, own), n - 1)
                hit = table[at] == own
                out[lo:hi] = np.where(hit, at + self.first[s], -1)
                counts[lo:hi] = np.where(hit, self.map("word-count", s, np.uint64, n)[at].astype(np.int64), 0)
        return out, counts

    def shards(self, keys: np.ndarray) -> np.ndarray:
        v = (keys >> np.uint64(32)).astype(np.int64)
        own = mix(keys >> np.uint64(32))
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)
            own = np.where(self.hot[at] == v, mix(keys), own)
        return (own % np.uint64(self.head["shards"])).astype(np.int64)

    def bigrams(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct keys."""
        out, shard = np.zeros(len(keys), np.int64), self.shards(keys)
        order = np.argsort(shard, kind="stable")
        shards, cut = np.unique(shard[order], return_index=True)
        for s, lo, hi in zip(shards.tolist(), cut, [*cut[1:], len(keys)]):
            n, i = self.head["pairs"].get(s, 0), order[lo:hi]
            if n:
                table = self.map("pair", s, np.uint64, n)
                at = np.minimum(np.searchsorted(table, keys[i]), n - 1)
                out[i] = np.where(table[at] == keys[i], self.map("pair-count", s, np.uint32, n)[at], 0)
        return out

    def dense(self, kind: str, numbers: np.ndarray) -> np.ndarray:
        """Values of a dense array at word numbers (sorted or not)."""
        width = 3 if kind == "context" else 1
        out = np.zeros((len(numbers), width), np.int64)
        if not self.head["pairs"]:
            return out
        part = numbers // RANGE
        for r in np.unique(part).tolist():
            m = part == r
            n = min(RANGE, self.head["words"] + 1 - r * RANGE)
            out[m] = self.map(kind, r, np.uint32, n * width).reshape(-1, width)[numbers[m] - r * RANGE]
        return out


_MODELS: dict[str, Model] = {}


def _model(folder: str, head: dict) -> Model:
    key = f"{folder}/{len(head)}"
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Model(folder, head)
    return _MODELS[key]


def _token_numbers(model: Model, b: pa.RecordBatch):
    """Of (.., text): word numbers and counts with the end of each text, and where each text's tokens begin."""
    words, off = hash_words(*column_bytes(b.column(1)))
    types, back = np.unique(words, return_inverse=True)
    num, cnt = model.numbers(types)
    to = off + np.arange(len(off))
    where = np.arange(len(words)) + np.repeat(np.arange(len(off) - 1), np.diff(off))
    tokens, counts = np.zeros(to[-1], np.int64), np.full(to[-1], model.head.get("docs", 0), np.int64)
    if len(words):
        tokens[where], counts[where] = num[back], cnt[back]
    return tokens, counts, to


def _contexts(tokens: np.ndarray, counts: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each token and its count; the boundary before the first."""
    v, c = np.roll(tokens, 1), np.roll(counts, 1)
    v[to[:-1]] = 0  # the boundary's count is the number of texts, as is the end's
    c[to[:-1]] = counts[to[1:] - 1]
    return v, c


def _bigrams_of(folder: str, head: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, size = _model(folder, head), [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return block_rows(list(blocks(k, c, model.shards(k))))

        for b in pieces(batches, 1):
            tokens, counts, to = _token_numbers(model, b)
            v, _ = _contexts(tokens, counts, to)
            held.append(v.astype(np.uint64) << np.uint64(32) | tokens.astype(np.uint64))
            size += len(tokens)
            if size > HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def _save_bigrams(folder: str):
    """Writes each shard; blocks of what it knows of each context (kinds 1 to 3) and word (0), by range of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, keys, counts in merged(batches):
            save(folder, f"pair.{s}", keys)
            save(folder, f"pair-count.{s}", counts.astype(np.uint32))
            out = []
            for kind in range(4):
                own = keys & _LOW if kind == 0 else keys[np.minimum(counts, 3) == kind] >> np.uint64(32)
                x, c = np.unique(own, return_counts=True)
                out += blocks(x, c, (x // np.uint64(RANGE)).astype(np.int64), kind)
            of = np.bincount(np.minimum(counts, 5), minlength=6)[1:5]
            out.append((-1, 0, pack(np.arange(4, dtype=np.uint64), of)))
            out.append((-1, 1, pack(np.array([s], np.uint64), np.array([len(keys)]))))  # the file's length
            yield block_rows(out)

    return run


def _save_dense(folder: str, words: int):
    """Writes the dense arrays of a range of word numbers; how many words follow 1 to 4 contexts, and all contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(r, own):
            size = min(RANGE, words + 1 - r * RANGE)
            a, ctx = np.zeros(size, np.uint32), np.zeros((size, 3), np.uint32)
            for kind, keys, counts in own:
                i = keys.astype(np.int64) - r * RANGE
                if kind:
                    ctx[i, kind - 1] = counts
                else:
                    a[i] = counts
            save(folder, f"follows.{r}", a)
            save(folder, f"context.{r}", ctx)
            of = np.bincount(np.minimum(a, 5), minlength=6)
            return row(1, [*of[1:5], a.sum(dtype=np.int64)])

        def row(kind, values):
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([[int(x) for x in values]], pa.list_(pa.int64()))], ["kind", "n"])

        at, own = None, []
        for s, kind, keys, counts in merged(batches):
            if s == -1 and kind:
                yield row(2, np.stack([keys.astype(np.int64), counts], axis=1).ravel())
                continue
            if s == -1:
                of = np.zeros(5, np.int64)
                of[keys.astype(int)] = counts
                yield row(0, of)
                continue
            if s != at and at is not None:
                yield close(at, own)
                own = []
            at = s
            own.append((kind, keys, counts))
        if at is not None:
            yield close(at, own)

    return run


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ of the modified Kneser-Ney method from the numbers of types seen once to four times."""
    if min(n[:2]) <= 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else float(k) / 2
        out.append(min(max(d, 0.05), k - 0.05))
    return out


def train(docs: DataFrame) -> tuple[str, dict]:
    """Counts (doc_id, text) and writes the model; returns its folder and head. No rows: a model that knows no word."""
    spark = docs.sparkSession
    folder = posix_dir(spark, "kneser-ney")
    bits = max(2, (docs.rdd.getNumPartitions() - 1).bit_length())
    dealt = lambda df, n: df.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "kind")
    saved = dealt(docs.mapInArrow(_words_of(bits), BLOCK), 1 << bits).mapInArrow(_save_words(folder), "shard long, kind long, types long, tokens long").collect()
    sizes = {r["shard"]: r for r in saved if r["kind"] == 0}
    texts = sum(r["tokens"] for r in saved if r["kind"] == 1)
    types = [sizes[s]["types"] if s in sizes else 0 for s in range(1 << bits)]
    words, tokens = sum(types), sum(r["tokens"] for r in sizes.values()) + texts
    if words > (1 << 32) - 2:
        raise ValueError("more words than 32-bit numbers")
    head = {"bits": bits, "first": [1 + int(x) for x in np.cumsum([0, *types[:-1]])], "types": types, "words": words, "tokens": tokens, "docs": texts, "shards": 1 << max(3, (tokens // SHARD).bit_length())}
    most = max(1, tokens // (4 * head["shards"]))
    first = head["first"]

    def hot(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for s in b.column(0).to_pylist():
                c = Model(folder, head).map("word-count", s, np.uint64, types[s])
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(c > most) + first[s])], ["id"])

    found = spark.range(0, 1 << bits, 1, 1 << bits).mapInArrow(hot, "id long").collect()  # fewer than 4 * shards
    head["hot"] = [0, *(r["id"] for r in found)]
    pairs = dealt(docs.mapInArrow(_bigrams_of(folder, head), BLOCK), head["shards"]).mapInArrow(_save_bigrams(folder), BLOCK)
    known = dealt(pairs, max(8, words // RANGE + 1)).mapInArrow(_save_dense(folder, words), "kind int, n array<long>").collect()  # a row a range, and a number a shard
    n = {kind: np.sum([r["n"] for r in known if r["kind"] == kind], axis=0).tolist() for kind in {r["kind"] for r in known} - {2}}
    head["pairs"] = {s: size for r in known if r["kind"] == 2 for s, size in zip(r["n"][::2], r["n"][1::2])}
    head["pair_discounts"], head["word_discounts"] = discounts(n.get(0, [0] * 5)), discounts(n.get(1, [0] * 5))
    head["pair_types"] = n.get(1, [0] * 5)[4]
    head["word_seen"] = n.get(1, [0] * 5)[:4]
    return folder, head


def _score(folder: str, head: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(folder, head | {"ready": 1})
        vocabulary = head["words"] + (head["docs"] > 0)
        d1, d2 = np.array([0.0, *head["pair_discounts"]]), np.array([0.0, *head["word_discounts"]])
        n1, n2 = head["word_seen"][:2]
        left = vocabulary - n1 - n2
        total = head["pair_types"]
        spare = (d2[1] * n1 + d2[2] * n2 + d2[3] * left) / total if total else 1.0
        for b in pieces(batches, 1):
            tokens, counts, to = _token_numbers(model, b)
            v, c_v = _contexts(tokens, counts, to)
            known = (tokens > 0) | ((tokens == 0) & (head["docs"] > 0))
            base = np.log10((counts + 0.5) / (head["tokens"] + 0.5 * (vocabulary + 1)))
            types, back = np.unique(np.maximum(tokens, 0), return_inverse=True)
            follows = np.where(tokens >= 0, model.dense("follows", types)[back, 0], 0)
            low = spare / (vocabulary + 1)
            if total:
                low = low + np.maximum(follows - d2[np.minimum(follows, 3)], 0) / total
            both = (v >= 0) & (tokens >= 0)
            keys, again = np.unique(np.where(both, np.maximum(v, 0).astype(np.uint64) << np.uint64(32) | np.maximum(tokens, 0).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF)), return_inverse=True)
            c = np.where(both, model.bigrams(keys)[again], 0)
            types, back = np.unique(np.maximum(v, 0), return_inverse=True)
            seen = model.dense("context", types)
            back_off = (seen * d1[1:]).sum(axis=1)[back]
            has = (v >= 0) & (c_v > 0)
            t = np.maximum(c_v, 1)
            p = np.where(has, np.maximum(c - d1[np.minimum(c, 3)], 0) / t + back_off / t * low, low)
            at = to[:-1]
            n = np.diff(to)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), at)), pa.array(np.full(b.num_rows, head["tokens"])), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def lm_scores(docs: DataFrame, fold: int = 5, held: int = 1) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from documents whose crc32(id as text) modulo ``fold`` isn't ``held`` and scores all. Null and empty texts
    hold one token, the end; a null id is learned from and isn't held out; rows that repeat count each. Scores are
    log10 probabilities; without training texts every token has the same probability. No documents give no rows.
    """
    rest = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % fold == held, F.lit(False))
    docs = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("held_out"))
    folder, head = train(docs.where("NOT held_out").select("doc_id", "text"))
    out = docs.mapInArrow(_score(folder, head), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Kneser-Ney scores of every document."""
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
