"""N-gram Jaccard join: size-aware heavy-light set similarity self-join, returned as components.

A document's set holds the 64-bit hashes of its distinct word shingles. Two sets link when
``100 * |A & B| >= threshold * |A | B|``; then their sizes a <= b keep ``100 * a >= threshold * b`` and
they share ``c(a, b) = ceil(threshold * (a + b) / (100 + threshold))`` elements at least.

* Copies with equal sets are one class, found by a 128-bit key with a combinable minimum.
* Light: a set of size a up to the boundary enumerates, for each partner size b, its subsets of the fixed
  size c(a, b). Two sets link exactly when they share such a subset.
* Heavy: larger sets scan inverted lists of their elements. All elements are counted; a set of size n is listed under
  its ``n - ceil(threshold * n / 100) + 1`` rarest ones alone (``Sizes.listed``), as linked sets must share one of those
  of both. An element that came once needs no list, so a set with enough elements of its own is in none, and the elements
  of a common passage are listed only for sets that hold little else.
* The boundary is the size at which the enumerated subsets of all sets cost the least together with the listed
  elements and the sets read for verification beyond it (``boundary_by_cost``, from the exact histogram of small sizes).
* Keys are counted by their 40 leading bits, as packed blocks. Keys that share these bits seem more frequent than they are,
  which changes the order of lists for all sets alike and loses nothing.
* Lists are never expanded into all pairs. Each member meets its list's smallest member (star), links are
  verified and joined to components; then only members of *different* components in one list are compared, by cell
  sketches that can't miss a link, in tiles of bounded bytes. What may link is verified, first one pair of each two
  components, then what is still apart.

Every step is exact: no cap on candidates, lists or sizes. Tables are cut at the shared folder.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from atlasweave.llm._packed import BLOCK as BLOCK_ROW
from atlasweave.llm._packed import HELD, block_rows, blocks, mapped, merged, save
from atlasweave.llm._spark import bounded, drop_ids, is_mounted, join_sized, keep_ids, posix_dir, written
from atlasweave.llm._text import column_bytes, hash_words, mix, ngrams, pieces

SMALL = 32  # the boundary is searched up to this size
TILE = 8 << 20  # bytes of sketches of an open list that one task compares with as many others
HOT = 1000  # a document in more pairs than this is dealt over several tasks
KEY_BITS, SHARD_KEYS = 40, 2_000_000  # keys are counted by so many bits, in shards for about so many keys


class Sizes:
    """What follows from the threshold for sizes: partners, required overlaps and listed elements."""

    def __init__(self, threshold: int):
        if not 50 < threshold <= 100:
            raise ValueError("threshold must be over 50 and at most 100 percent")
        self.t = threshold

    def overlap(self, a: int, b: int) -> int:
        return -(-self.t * (a + b) // (100 + self.t))

    def apart(self, a: int, b: int) -> int:
        """The largest symmetric difference of linked sets of these sizes."""
        return (100 - self.t) * (a + b) // (100 + self.t)

    def partners(self, a: int) -> range:
        return range(-(-self.t * a // 100), 100 * a // self.t + 1)

    def others(self, a: int) -> bool:
        """Whether a set of this size can link with a set that isn't equal."""
        return self.partners(a)[-1] > a or self.partners(a)[0] < a or self.apart(a, a) >= 2

    def listed(self, a: int) -> int:
        """How many of its rarest elements a set is listed under: all but the overlap with its smallest partner, less one."""
        return a - -(-self.t * a // 100) + 1

    def subsets(self, a: int, most: int) -> list[tuple[int, int]]:
        """Partner sizes up to ``most`` and the size of the subsets enumerated for them; equal sets need none."""
        out = []
        for b in self.partners(a):
            c = self.overlap(a, b)
            if b <= most and c <= min(a, b) and not (a == b == c):
                out.append((b, c))
        return out


def _sketch(s: np.ndarray) -> bytes:
    """One byte for each of 2**j cells, half the size at least; halving the cells adds neighbours."""
    cells = 1 << max(3, math.ceil(math.log2(max(1, len(s)) / 2)))
    h = mix(s ^ np.uint64(0x5CE7C4))
    return (np.bincount((h >> np.uint64(64 - int(math.log2(cells)))).astype(np.int64), weights=(h & np.uint64(255)).astype(float), minlength=cells).astype(np.int64) & 255).astype(np.uint8).tobytes()


def _folded(m: np.ndarray, cells: int) -> np.ndarray:
    while m.shape[-1] > cells:
        m = m[..., ::2] + m[..., 1::2]
    return m


def _batch_sets(b: pa.RecordBatch, n_words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row of (id, text)."""
    buf, off = column_bytes(b.column(1))
    words, at = hash_words(buf, off)
    grams, to = ngrams(words, at, n_words)
    for i in range(b.num_rows):
        if to[i + 1] > to[i]:
            yield np.unique(grams[to[i] : to[i + 1]])
        elif at[i + 1] > at[i]:
            w = words[at[i] : at[i + 1]]
            yield ngrams(w, np.array([0, len(w)]), len(w))[0]
        else:
            yield np.zeros(0, np.uint64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    off = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.uint64).view(np.int64)))


def _signatures(n_words: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(threshold)
        for b in pieces(batches, 1):
            n, k1, k2, sketch = [], [], [], []
            for s in _batch_sets(b, n_words):
                n.append(len(s))
                k1.append(np.add.reduce(mix(s + np.uint64(0x51))) if len(s) else np.uint64(0))
                k2.append(np.add.reduce(mix(s ^ np.uint64(0xF00D5))) if len(s) else np.uint64(0))
                sketch.append(_sketch(s) if len(s) and sizes.others(len(s)) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(np.array(k1, np.uint64).view(np.int64)), pa.array(np.array(k2, np.uint64).view(np.int64)), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return run


def _sets(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 1):
            sets = list(_batch_sets(b, n_words))
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(sets)], ["doc_id", "shingles"])

    return run


def boundary_by_cost(histogram: dict[int, int], threshold: int) -> int:
    """The largest size whose sets enumerate subsets: the cheapest over the histogram {size: sets} of small sizes."""
    sizes = Sizes(threshold)
    light = {s: sum(math.comb(s, c) for _, c in sizes.subsets(s, SMALL)) for s in range(1, SMALL + 1)}
    heavy = {s: 2 * s + sizes.listed(s) for s in range(1, SMALL + 1)}  # counted, listed and read again
    return min(range(SMALL + 1), key=lambda x: (sum(n * (light if s <= x else heavy)[s] for s, n in histogram.items() if 1 <= s <= SMALL), x))


def _keys_of(n_words: int, threshold: int, boundary: int):
    """(doc_id, text) to its keys: a batch of (doc_id, text) gives (keys, row, rank) for it.

    rank is how many of its keys a set is listed under, 0 for a light set's subsets: they are all listed.
    """
    sizes = Sizes(threshold)

    def of(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys, rows, ranks = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def add(k: np.ndarray, row: int, rank: int) -> None:
            keys.append(k)
            rows.append(np.full(len(k), row))
            ranks.append(np.full(len(k), rank))

        for i, s in enumerate(_batch_sets(b, n_words)):
            n = len(s)
            if 0 < n <= boundary:
                for t, c in sizes.subsets(n, boundary):
                    sums = [np.add.reduce(mix(np.array(x, np.uint64) + np.uint64(7))) for x in combinations(s.tolist(), c)]
                    add(mix(np.array(sums, np.uint64) ^ np.uint64((min(n, t) << 20) + max(n, t))), i, 0)
            if n and sizes.others(n) and sizes.partners(n)[-1] > boundary:
                add(mix(s + np.uint64(0xB10C)), i, sizes.listed(n))
        return np.concatenate(keys), np.concatenate(rows), np.concatenate(ranks)

    return of


def _listed(keys: np.ndarray, rows: np.ndarray, ranks: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions of the keys that are listed: all subsets and the rarest elements of each row, of those that came more than once."""
    alone = np.bincount(rows[(counts < 2) & (ranks > 0)], minlength=int(rows.max(initial=0)) + 1)
    at = np.flatnonzero((counts > 1) & ((ranks == 0) | (alone[rows] < ranks)))
    at = at[np.lexsort((keys[at], counts[at], rows[at], ranks[at] > 0))]
    if not len(at):
        return at
    r, heavy = rows[at], ranks[at] > 0
    start = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (heavy[1:] != heavy[:-1])]))
    place = np.arange(len(r)) - np.repeat(start, np.diff([*start, len(r)])) + alone[r]
    return at[~heavy | (place < ranks[at])]


def _key_blocks(of, bits: int):
    """(doc_id, text) to all its keys as blocks by their leading bits, each key with how often the task met it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            k, c = np.unique(np.concatenate(held), return_counts=True)
            return block_rows(list(blocks(k, c, (k >> np.uint64(KEY_BITS - bits)).astype(np.int64))))

        for b in pieces(batches, 1):
            held.append(of(b)[0] >> np.uint64(64 - KEY_BITS))
            size += len(held[-1])
            if size > HELD // 2:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return run


def _save_shared(folder: str):
    """Writes the keys that were met twice or more, sorted, one file a shard, and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, _, keys, counts in merged(batches):
            often = counts > 1
            save(folder, f"shared.{s}", keys[often])
            save(folder, f"count.{s}", np.minimum(counts[often], 0xFFFFFFFF).astype(np.uint32))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([int(often.sum())], pa.int64())], ["shard", "n"])

    return run


def _in_lists(folder: str, of, bits: int, n_of: dict[int, int]):
    """(doc_id, text) to the (key, doc_id) of its lists; ``n_of`` tells how many keys the file of a shard has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in pieces(batches, 1):
            keys, rows, ranks = of(b)
            short = keys >> np.uint64(64 - KEY_BITS)
            order = np.argsort(short)
            own, counts = short[order], np.ones(len(keys), np.int64)
            shards, at = np.unique(own >> np.uint64(KEY_BITS - bits), return_index=True)
            for s, lo, hi in zip(shards.tolist(), at, [*at[1:], len(own)]):
                if s not in tables:
                    tables[s] = mapped(folder, f"shared.{s}", np.uint64, n_of[s]), mapped(folder, f"count.{s}", np.uint32, n_of[s])
                t, c = tables[s]
                if len(t):
                    i = np.minimum(np.searchsorted(t, own[lo:hi]), len(t) - 1)
                    counts[order[lo:hi]] = np.where(t[i] == own[lo:hi], c[i], 1)
            keep = _listed(keys, rows, ranks, counts)
            yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), b.column(0).take(pa.array(rows[keep]))], ["key", "doc_id"])

    return run


def _key_rows(of):
    """(doc_id, text) to a row for each key, with the set's own number in its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for b in pieces(batches, 1):
            keys, rows, ranks = of(b)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), b.column(0).take(pa.array(rows)), pa.array(rows + before), pa.array(ranks)], ["key", "doc_id", "row", "rank"])
            before += b.num_rows

    return run


def list_members(docs: DataFrame, of, n_keys: int) -> DataFrame:
    """(key, doc_id) of all lists; ``n_keys`` tells about how many keys there are, for the number of shards.

    Where the shared folder is mounted, the counts of keys that came more than once are mapped by the workers. Else they
    are joined by a shuffle.
    """
    spark = docs.sparkSession
    if not is_mounted(spark):
        keys = docs.mapInArrow(_key_rows(of), "key long, doc_id long, row long, rank long").withColumn("task", F.spark_partition_id())
        keys = written(keys, "keys")
        common = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        counted = join_sized(keys, common, ["key"], how="left").withColumn("n", F.coalesce("n", F.lit(1)))
        place = F.row_number().over(W.partitionBy("task", "row", F.col("rank") > 0).orderBy("n", "key"))  # the keys of one set
        return counted.withColumn("place", place).where("n > 1 AND (rank = 0 OR place <= rank)").select("key", "doc_id")
    bits = min(20, max(3, (n_keys // SHARD_KEYS).bit_length()))
    folder = posix_dir(spark, "list-keys")
    dealt = docs.mapInArrow(_key_blocks(of, bits), BLOCK_ROW).repartitionById(1 << bits, F.col("shard")).sortWithinPartitions("shard", "kind")
    n_of = {r["shard"]: r["n"] for r in dealt.mapInArrow(_save_shared(folder), "shard long, n long").collect()}  # a row a shard
    return docs.mapInArrow(_in_lists(folder, of, bits, n_of), "key long, doc_id long")


def _near(threshold: int):
    """Pairs (a, b, n and sketch of both) that may link by their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(threshold)
        for b in batches:
            na, nb = b.column(2).to_pylist(), b.column(4).to_pylist()
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y, u, v) in enumerate(zip(na, nb, b.column(3), b.column(5))):
                if 100 * min(x, y) < threshold * max(x, y):
                    continue
                u, v = (np.frombuffer(z.as_py(), np.uint8) for z in (u, v))
                cells = min(len(u), len(v))
                keep[i] = np.count_nonzero(_folded(u, cells) != _folded(v, cells)) <= sizes.apart(x, y)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def near_pairs(side: np.ndarray, comp: np.ndarray, n: np.ndarray, sketches: list[bytes], threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row those rows of another component, and of the other side if there are two, that may link, and how many cells differ.

    Every pair comes once. Sets that link differ in size so little that one has at most twice the cells of the other.
    """
    two = side.min() != side.max()
    cells = np.array([len(x) for x in sketches])
    tables = {}
    for c in np.unique(cells).tolist():
        for of in (c, 2 * c):
            rows = np.flatnonzero(cells == of)
            rows = rows[np.argsort(n[rows], kind="stable")]
            if len(rows):
                tables[c, of] = rows, _folded(np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), of), c)
    for (c, of), (rows, m) in tables.items():
        left, own = tables[c, c]
        size = n[rows]
        for k, i in enumerate(left):
            # partners are larger, or as large and later
            lo = np.searchsorted(size, n[i], "left") if of > c else k + 1
            hi = np.searchsorted(size, 100 * n[i] // threshold, "right")
            if hi <= lo:
                continue
            j = rows[lo:hi]
            ok = comp[j] != comp[i]
            if two:
                ok &= side[j] != side[i]
            if not ok.any():
                continue
            at = np.flatnonzero(ok)
            far = np.count_nonzero(m[lo + at] != own[k], axis=1)
            hit = far <= (100 - threshold) * (n[j[at]] + n[i]) // (100 + threshold)
            if hit.any():
                yield int(i), j[at[hit]], far[hit]


def _across(threshold: int, first: bool):
    """Sorted rows (lead, p, q, side, doc_id, comp, n, sketch, keys) to pairs of different components that may link.

    Rows of one (lead, p, q) are the members of tiles p and q of the open lists of one lead. They are compared list by list,
    or all at once if that is less. With ``first`` only the nearest pair of each two components of the rows comes, and
    whether there are more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, out = [], None, {}

        def close():
            side, ids, comp, n, sketch, keys = zip(*held)
            side, ids, comp, n = map(np.array, (side, ids, comp, n))
            member = np.repeat(np.arange(len(ids)), [len(k) for k in keys])
            keys = np.concatenate(keys)
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            lists = np.split(member[order], cuts)
            if sum(len(x) ** 2 for x in lists) >= len(ids) ** 2:
                lists = [np.arange(len(ids))]
            for x in lists:
                if len(x) > 1 and (comp[x] != comp[x[0]]).any():
                    for i, others, far in near_pairs(side[x], comp[x], n[x], [sketch[i] for i in x], threshold):
                        add(ids[x], comp[x], i, others, far)

        def add(ids, comp, i, others, far):
            for j, d in zip(others.tolist(), far.tolist()):
                pair = (int(min(ids[i], ids[j])), int(max(ids[i], ids[j])))
                two = (int(min(comp[i], comp[j])), int(max(comp[i], comp[j])))
                if not first:
                    out[pair] = (*two, d, *pair, False)
                elif two not in out:
                    out[two] = (*two, d, *pair, False)
                elif out[two][3:5] != pair:
                    out[two] = (*min(out[two][:5], (*two, d, *pair)), True)

        def flush():
            rows = list(zip(*out.values())) or [()] * 6
            out.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:5]), pa.array(rows[5], pa.bool_())], ["ca", "cb", "far", "a", "b", "more"])

        for b in batches:
            keys = b.column(8)
            flat, off = keys.values.to_numpy(zero_copy_only=False), keys.offsets.to_numpy()
            for i, row in enumerate(zip(*(b.column(c).to_pylist() for c in range(8)))):
                if row[:3] != at:
                    if len(held) > 1:
                        close()
                    held, at = [], row[:3]
                    if len(out) > 50_000:
                        yield flush()
                held.append((*row[3:], flat[off[i] : off[i + 1]]))
        if len(held) > 1:
            close()
        yield flush()

    return run


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (doc_id, component): minimum labels with pointer jumping, a table in the shared folder each round."""
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = written(labels.join(near, "a").select("a", "label", F.least("label", "other").alias("next")), "labels")
        jump = step.select(F.col("a").alias("next"), F.col("next").alias("top"))
        new = written(step.join(jump, "next").select("a", F.least("next", "top").alias("label"), (F.least("next", "top") != F.col("label")).alias("moved")), "labels")
        labels = new.select("a", "label")
        if not new.where("moved").limit(1).count():
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("component"))


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """The components after joining those of (ca, cb)."""
    top = components(more.select(F.col("ca").alias("a"), F.col("cb").alias("b"))).toDF("old", "new")
    known = comps.select(F.col("doc_id"), F.col("component").alias("old"))
    alone = top.select(F.col("old").alias("doc_id"), F.col("old")).join(known.select("doc_id"), "doc_id", "left_anti")
    return written(known.union(alone).join(top, "old", "left").select("doc_id", F.coalesce("new", "old").alias("component")), "components")


def _attached(pairs: DataFrame, values: DataFrame) -> DataFrame:
    """Pairs (a, b, ..) with the columns of ``values`` of both, as structs va and vb.

    A document of very many pairs is copied to several tasks, each for its share of the pairs.
    """
    out = pairs
    for side, other in ("ab", "ba"):
        hot = pairs.groupBy(side).count().where(F.col("count") > HOT).select(side, F.ceil(F.col("count") / HOT).cast("int").alias("parts"))
        hot = written(hot, "hot")  # at most a thousandth of the pairs
        own = values.select(F.col("doc_id").alias(side), F.struct(*(c for c in values.columns if c != "doc_id")).alias(f"v{side}"))
        own = join_sized(own, hot, [side], "left", None).withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
        out = join_sized(out, hot, [side], "left", None).withColumn("at", F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        out = out.join(own, [side, "at"]).drop("at")
    return out


def _verified(docs: DataFrame, pairs: DataFrame, n_words: int, threshold: int) -> DataFrame:
    """The pairs (a, b, ..) whose whole sets link, by the texts of the documents in pairs alone."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    sets = keep_ids(docs, ids, "doc_id").mapInArrow(_sets(n_words), "doc_id long, shingles array<long>")
    sets = sets.withColumn("h", F.xxhash64("shingles")).dropDuplicates(["doc_id", "h"]).drop("h")  # an id may have several sets
    both = _attached(pairs, written(sets, "whole-sets")).withColumn("common", F.size(F.array_intersect("va.shingles", "vb.shingles")))
    return both.where(F.col("common") * 100 >= (F.size("va.shingles") + F.size("vb.shingles") - F.col("common")) * threshold).select(*pairs.columns).distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = 5, threshold: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest id reachable by links, its own included).

    ids are expected to be distinct (rows that repeat an id are the same node). Null or wordless text: an empty set,
    alone in its component. Fewer words than ``n_words``: the whole sequence is one shingle. A null id gets a null
    component and links with nothing. Ties can't matter; an empty table gives an empty result. Other columns are
    ignored. Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z.
    """
    docs = bounded(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    all_sets = written(docs.mapInArrow(_signatures(n_words, threshold), "doc_id long, n_shingles long, k1 long, k2 long, sketch binary"), "sets")
    sets = all_sets.where("n_shingles > 0 AND doc_id IS NOT NULL")
    one = ["n_shingles", "k1", "k2"]
    classes = written(sets.groupBy(*one).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "classes")
    # an id with different sets is no copy of another: as a node of its own it keeps the links of all its sets
    mixed = written(sets.groupBy("doc_id").agg(F.min(F.struct(*one)).alias("lo"), F.max(F.struct(*one)).alias("hi")).where("lo != hi").select("doc_id"), "mixed")
    copies = join_sized(sets.select("doc_id", *one), classes, one).where("doc_id != rep").select("doc_id", "rep").distinct()
    copies = written(drop_ids(copies, mixed, "doc_id"), "copies")
    reps = drop_ids(sets, copies, "doc_id")
    sized = reps.groupBy(F.least("n_shingles", F.lit(SMALL + 1)).alias("size")).agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).collect()  # SMALL + 1 rows
    boundary = boundary_by_cost({r["size"]: r["n"] for r in sized}, threshold)
    # keys are made twice, once for counting and once for the members of lists, as they are larger than the texts
    rest = drop_ids(docs.where("doc_id IS NOT NULL AND text IS NOT NULL"), copies, "doc_id").select("doc_id", "text")
    listed = written(list_members(rest, _keys_of(n_words, threshold, boundary), sum(r["shingles"] for r in sized)), "listed")
    heads = written(listed.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("lead != last").drop("last"), "heads")
    members = written(join_sized(listed, heads, ["key"]).select("key", "lead", "doc_id"), "members")
    light = reps.select("doc_id", "n_shingles", "sketch")
    cells = written(keep_ids(light, members, "doc_id"), "cells")
    star = written(members.where("doc_id != lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct(), "star")
    star = _attached(star, cells).select("a", "b", F.col("va.n_shingles").alias("na"), F.col("va.sketch").alias("sa"), F.col("vb.n_shingles").alias("nb"), F.col("vb.sketch").alias("sb"))
    star = written(star.mapInArrow(_near(threshold), "a long, b long").distinct(), "pairs")
    comps, tested = components(written(_verified(docs, star, n_words, threshold), "links")), star
    # members of different components in one list: the nearest of each two components, then what is still apart
    for first in (True, False):
        named = members.join(comps, "doc_id", "left").select("key", "lead", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        open_lists = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo != hi").select("key", "n")
        rows = join_sized(named, written(open_lists, "open"), ["key"]).groupBy("lead", "doc_id", "comp").agg(F.collect_list("key").alias("keys"))  # the lists of one document
        rows = written(rows.join(cells, "doc_id"), "open-rows")
        sized = rows.groupBy("lead").agg(F.ceil(F.sum(F.length("sketch")) / TILE).cast("int").alias("parts"), F.count("*").alias("n"))
        rows = join_sized(rows, written(sized, "tiles"), ["lead"]).withColumn("own", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select("lead", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).cast("int").alias("side"), "doc_id", "comp", "n_shingles", "sketch", "keys")
        found = rows.repartition("lead", "p", "q").sortWithinPartitions("lead", "p", "q").mapInArrow(_across(threshold, first), "ca long, cb long, far long, a long, b long, more boolean")
        pair = F.struct("a", "b")
        if first:
            best = F.min(F.struct("far", "a", "b")).alias("x")
            found = found.groupBy("ca", "cb").agg(best, (F.max("more") | (F.min(pair) != F.max(pair))).alias("more")).select("ca", "cb", "x.a", "x.b", "more")
        else:
            found = found.select("ca", "cb", "a", "b", "more").distinct()
        found = written(found, "pairs")
        new = found.select("ca", "cb", "a", "b").join(tested, ["a", "b"], "left_anti")
        more = written(_verified(docs, written(new, "pairs"), n_words, threshold), "links")
        if more.limit(1).count():
            comps = _joined(comps, more)
        if not found.where("more").limit(1).count():
            break
        tested = tested.union(found.select("a", "b"))
    out = all_sets.select("doc_id", "n_shingles").join(copies, "doc_id", "left")
    out = out.withColumn("node", F.coalesce("rep", "doc_id")).join(comps.toDF("node", "component"), "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=3, threshold=90)
