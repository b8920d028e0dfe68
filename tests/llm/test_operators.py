"""Every corpus operator against a plain version, over a small table with nulls, empties, ties, repeats and clashing columns."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest

from atlasweave.llm import bpe, decontamination, html_text, jaccard_join, kneser_ney, language_id, license_scan, quality_rules, token_counts, weak_quality

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, accepted string, key long, component_id long, quality double"


def rows():
    rng = random.Random(3)
    vocabulary = {"en": "the of and to in that it with for this from".split(), "fr": "le la les des une dans pour avec est sur".split(), "de": "der die das und nicht mit auf ein ist von".split()}
    out = []
    for i in range(120):
        lang = ["en", "fr", "de"][i % 3]
        n = [1, 2, 3, 5, 9, 12, 19, 21, 60, 200][i % 10]
        words = [rng.choice(vocabulary[lang]) if rng.random() < 0.5 else "".join(rng.choice("abcdeioust") for _ in range(rng.randint(2, 8))) for _ in range(n)]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    base = out[9][1].split()
    for k in range(20):  # near copies by one changed word, and copies
        w = list(base)
        if k % 4:
            w[rng.randrange(len(w))] = f"changed{k}"
        out.append((200 + k, " ".join(w), "en"))
    out += [(300, None, "en"), (301, "", "fr"), (302, " \n\t ", None), (None, "a text without id here", "en"), (303, "one", "de"), (304, "One", None), (305, "x " * 50 + "a b c d e f g h i j " * 40, "en"), (306, "é́ İ ß 日本語 \x1c\x1f\x85 word Κ", "en"), (307, "$$$ ### " * 40, "en")]
    out += [(308, "w" * 300_000 + " tail " + "long text " * 30_000, "en"), (309, "same line\nsame line\n\n \nsame line\r\nother", "en"), (310, "123 !!! ...", "en")]
    out += [out[5], out[5], (300, None, "en")]
    return [(i, t, lang, "src", len(t or ""), "clash", 1, 2, 0.5) for i, t, lang in out]


@pytest.fixture(scope="module")
def data():
    return rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["doc_id"]].append(r)
    return out


def texts(data):
    return {r[0]: r[1] or "" for r in data}


# 1


def base_counts(t):
    w = WORD.findall(t)
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, data, nothing):
    labels = spark.createDataFrame([(i, 1, 0, "x") for i in range(0, 60)] + [(None, 1, 0, "x"), (3, 1, None, "x"), (307, 0, 0, "x"), (307, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    got = by_id(quality_rules.quality_rules(docs, labels))
    assert sum(map(len, got.values())) == len(data)
    for i, t in texts(data).items():
        for r in got[i]:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(t), i
            assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
            assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    assert quality_rules.quality_rules(nothing, labels).count() == 0
    none = quality_rules.quality_rules(docs, labels.limit(0)).collect()
    assert len(none) == len(data) and all(r["score"] == 0 for r in none)


def test_quality_ratio_by_hand(spark):
    import xxhash

    def h64(b, seed=42):
        x = xxhash.xxh64_intdigest(b, seed)
        return x - (1 << 64) if x >> 63 else x

    def features(t):
        w = t.split()
        pair = lambda a, b: h64(b.encode(), h64(a.encode()) & (1 << 64) - 1)
        out = [h64(x.encode()) for x in w] + [pair("-", x[-3:]) for x in w] + [pair(a, b) for a, b in zip(w, w[1:])]
        return [x % quality_rules.BUCKETS for x in out]

    rows = [(1, "good words are here and there"), (2, "bad$$$ words### are|here"), (3, "good and there")]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()}
    raw = collections.Counter(b for _, t in rows for b in features(t))
    good = collections.Counter(features(rows[0][1]))
    n, m, prior = sum(raw.values()), sum(good.values()), quality_rules.PRIOR
    p = lambda b: (raw[b] + 1) / (n + quality_rules.BUCKETS)
    for i, t in rows:
        want = [math.log((good[b] + prior * p(b)) / (m + prior) / p(b)) for b in features(t)]
        assert got[i] == pytest.approx(sum(want) / len(want), abs=1e-5)


# 2


def shingles(t, n):
    w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(table, n, threshold):
    sets = {i: shingles(t, n) for i, t in table.items() if i is not None}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                c = len(sets[a] & sets[b])
                if 100 * c >= threshold * (len(sets[a]) + len(sets[b]) - c):
                    x, y = sorted((find(a), find(b)))
                    top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("n", "threshold"), [(3, 90), (5, 80), (1, 70)])
def test_jaccard_join(docs, data, nothing, n, threshold):
    got = by_id(jaccard_join.jaccard_components(docs, n_words=n, threshold=threshold))
    assert sum(map(len, got.values())) == len(data)
    for i, want in brute_components(texts(data), n, threshold).items():
        assert {(r["n_shingles"], r["component_id"]) for r in got[i]} == {want}, i
    assert {r["component_id"] for r in got[None]} == {None}
    assert jaccard_join.jaccard_components(nothing, n_words=n, threshold=threshold).count() == 0


def test_jaccard_join_of_repeated_ids(spark):
    rng = random.Random(5)
    a, b, c, d, e = ([f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(5))
    near = lambda w: " ".join([*w[:-1], "last"])
    a, b, c, d, e = ((" ".join(w), near(w)) for w in (a, b, c, d, e))
    table = [(1, a[0]), *[(2, a[0])] * 3, (5, a[0]), (5, b[0]), (7, b[1]), (10, c[0]), (10, d[0]), (11, c[1]), (12, d[1]), (20, e[0]), (21, e[1]), (21, e[1])]
    got = jaccard_join.jaccard_components(spark.createDataFrame(table, "doc_id long, text string"), n_words=3, threshold=80).collect()
    want = {1: 1, 2: 1, 5: 1, 7: 1, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted((i, want[i]) for i, _ in table)


def test_jaccard_boundary_follows_cost():
    assert jaccard_join.boundary_by_cost({12: 1000}, 90) >= 12
    assert jaccard_join.boundary_by_cost({30: 1000}, 60) < 30


def test_jaccard_across_components(spark):
    """A chain whose ends don't link with the list's smallest member."""
    words = [f"w{i}" for i in range(300)]
    table = {}
    for k in range(24):
        w = list(words)
        for j in range(k):
            w[j * 12] = f"x{j}"
        table[100 - k if k % 2 else 200 + k] = " ".join(w)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(list(table.items()), "doc_id long, text string"), n_words=3, threshold=90).collect()}
    assert got == {i: c for i, (_, c) in brute_components(table, 3, 90).items()}


def near_group(n):
    """Copies of one text with up to five changed words; that with the smallest id is far from all others."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(104)]
    table = {}
    for k in range(n):
        w = list(base)
        for _ in range(12 if k == 0 else rng.choice([1, 1, 2, 2, 3, 5])):
            w[rng.randrange(104)] = f"x{rng.randrange(400)}"
        table[7 + k] = " ".join(w)
    for k in range(12):  # texts of which half is a common passage, and texts with half of the passage
        table[5000 + k] = " ".join(base[:52] + [f"y{k}.{j}" for j in range(52)])
        table[6000 + k] = " ".join(base[: 26 + k] + [f"z{j}" for j in range(26)])
    return table


@pytest.mark.parametrize(("mounted", "tile", "hot"), [(True, 8 << 20, 1000), (True, 3000, 20), (False, 8 << 20, 1000)])
def test_jaccard_in_a_large_near_group(spark, monkeypatch, mounted, tile, hot):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    if not mounted:
        monkeypatch.setattr(jaccard_join, "is_mounted", lambda spark: False)
    table = near_group(300)
    want = {i: c for i, (_, c) in brute_components(table, 5, 80).items()}
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(list(table.items()), "doc_id long, text string")).collect()}
    assert got == want
    assert len(set(want.values())) > 20 and max(collections.Counter(want.values()).values()) > 100


def test_jaccard_needs_whole_files(tmp_path):
    jaccard_join.save(str(tmp_path), "shared.0", np.arange(4, dtype=np.uint64))
    assert jaccard_join.mapped(str(tmp_path), "shared.0", np.uint64, 4).tolist() == [0, 1, 2, 3]
    for name, n in (("shared.0", 5), ("shared.1", 0)):
        with pytest.raises(OSError):
            jaccard_join.mapped(str(tmp_path), name, np.uint64, n)


# 3 and 7


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers as p
    import tiktoken

    ranks = bpe.read_ranks(p.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks={x: i for i, x in enumerate(ranks)}, special_tokens={})


def test_bpe(docs, data, nothing, reference_bpe):
    got = by_id(bpe.digests(docs))
    assert sum(map(len, got.values())) == len(data)
    for i, t in texts(data).items():
        ids = reference_bpe.encode_ordinary(t)
        for r in got[i]:
            assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
            assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()), i
    assert bpe.digests(nothing).count() == 0


def test_bpe_pieces_of_odd_text(reference_bpe):
    import public_tokenizers as p

    codec = bpe.Codec(bpe.read_ranks(p.path("byte_bpe_50k.tiktoken")), p.PATTERN)
    rng = random.Random(1)
    parts = ["a", "the", " ", "\n", "\t", "\x1c", "\x85", " ", "é", "ß", "日本", "123", "'s", "!!", "Ⅷ", "²", "\x00", "<|endoftext|>", "😀", "İ", "　"]
    for _ in range(2000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        ids = np.frombuffer(codec.encode(t), "<u4").tolist()
        assert ids == reference_bpe.encode_ordinary(t) and codec.decode(ids) == t.encode()


@pytest.mark.parametrize("block", [7, 101, 1 << 20])
def test_token_counts(docs, data, nothing, block):
    want = collections.Counter((r["doc_id"], r["n_tokens"]) for r in bpe.digests(docs.where("doc_id IS NULL OR doc_id <> 308")).collect())
    got = collections.Counter((r["doc_id"], r["n_tokens"]) for r in token_counts.document_token_counts(docs.where("doc_id IS NULL OR doc_id <> 308"), block=block).collect())
    assert got == want
    assert token_counts.document_token_counts(nothing).count() == 0


def test_token_file_without_last_separator(spark, tmp_path):
    np.array([5, 9, 9, 9, 1, 2, 9, 3, 4, 4, 4, 4, 4], "<u2").tofile(tmp_path / "a.tokens")
    np.array([7] * 10, "<u2").tofile(tmp_path / "b.tokens")
    (tmp_path / "c.tokens").touch()
    for block in (1, 2, 3, 100):
        got = sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path), 9, block=block).collect()))
        assert got == [("a.tokens", 0, 1, True), ("a.tokens", 1, 0, True), ("a.tokens", 2, 0, True), ("a.tokens", 3, 2, True), ("a.tokens", 4, 6, False), ("b.tokens", 0, 10, False)]


def test_token_width(spark, tmp_path):
    assert [token_counts.width_of(50256, 50256), token_counts.width_of(65536, 3), token_counts.width_of(65536, 65536), token_counts.width_of(200_000, 5)] == ["<u2", "<u2", "<u4", "<u4"]
    encoded = spark.createDataFrame([(1, [5, 115_792, 70_000]), (2, [])], "doc_id long, ids array<int>").coalesce(1)
    (tmp_path / "wide").mkdir()
    token_counts.write_token_files(encoded, str(tmp_path / "wide"), 50256, "<u4")
    assert sorted(map(tuple, token_counts.count_tokens(spark, str(tmp_path / "wide"), 50256, "<u4").select("ordinal", "n_tokens").collect())) == [(0, 3), (1, 0)]
    with pytest.raises(Exception, match="doesn't fit"):
        token_counts.write_token_files(encoded, str(tmp_path), 50256, "<u2")


# 4


def test_kneser_ney_needs_whole_files(docs):
    folder, head = kneser_ney.train(docs.select("doc_id", "text"))
    model = kneser_ney.Model(folder, head)
    shard = max(head["pairs"], key=head["pairs"].get)
    assert len(model.map("pair", shard, np.uint64, head["pairs"][shard])) == head["pairs"][shard]
    with open(f"{folder}/pair.{shard}", "ab") as f:
        f.write(b"12345678")
    with pytest.raises(OSError):
        kneser_ney.Model(folder, head).map("pair", shard, np.uint64, head["pairs"][shard])


def test_kneser_ney(docs, data, nothing):
    got = by_id(kneser_ney.lm_scores(docs))
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower()) + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    unigrams, bigrams = collections.Counter(), collections.Counter()
    for r in data:
        if not held(r[0]):
            w = tokens(r[1] or "")
            unigrams.update(w)
            bigrams.update(zip([0, *w], w))
    n, v = sum(unigrams.values()), len(unigrams)
    follows = collections.Counter(w for _, w in bigrams)
    totals, seen = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), c in bigrams.items():
        totals[a] += c
        seen[a][min(c, 3) - 1] += 1
    of = lambda c: [sum(x == k for x in c.values()) for k in (1, 2, 3, 4)]
    d, e = kneser_ney.discounts(of(bigrams)), kneser_ney.discounts(of(follows))
    few = of(follows)
    spare = (e[0] * few[0] + e[1] * few[1] + e[2] * (v - few[0] - few[1])) / len(bigrams)
    low = lambda w: spare / (v + 1) + (max(follows[w] - e[min(follows[w], 3) - 1], 0) / len(bigrams) if follows[w] else 0)
    assert sum(low(w) for w in unigrams) + low("unknown") == pytest.approx(1)

    def p(a, w):
        if a not in totals:
            return low(w)
        c = bigrams[a, w]
        return (c - d[min(c, 3) - 1] if c else 0) / totals[a] + sum(x * y for x, y in zip(d, seen[a])) / totals[a] * low(w)

    for i, t in texts(data).items():
        w = tokens(t)
        for r in got[i]:
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(x in unigrams for x in w), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((unigrams[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
            assert r["score"] == pytest.approx(sum(math.log10(p(a, x)) for a, x in zip([0, *w], w)))
    assert kneser_ney.lm_scores(nothing).count() == 0
    only_held = docs.where("doc_id IS NOT NULL AND crc32(cast(doc_id AS string)) % 5 = 1")
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in kneser_ney.lm_scores(only_held).collect())


# 5 and 8


def test_samples_are_bounded(spark, monkeypatch):
    """Very many rows of one id, equal or not, are as few examples as others."""
    for module in (language_id, weak_quality):
        monkeypatch.setattr(module, "SAMPLE", 10)
    rows = [(1, f"one row of many with number {k % 40} and words", "en") for k in range(400)] + [(k, f"eine andere Zeile {k}", "de") for k in range(2, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7)
    seen = {}
    for module, name in ((language_id, "fit"), (weak_quality, "fit_scorer")):
        fit = getattr(module, name)
        monkeypatch.setattr(module, name, lambda found, fit=fit, module=module: seen.setdefault(module, []).append(found) or fit(found))
        module.train(df)
        module.train(df.repartition(3))
    langs = collections.Counter(x[0] for x in seen[language_id][0])
    assert langs == {"en": 10, "de": 10} and len({x[1].tobytes() for x in seen[language_id][0]}) == 20
    assert 10 <= len(seen[weak_quality][0]) <= 20
    for a, b in seen.values():
        assert [(x[0], x[-2].tobytes()) for x in a] == [(x[0], x[-2].tobytes()) for x in b]


def test_examples_for_the_driver(spark, monkeypatch):
    """What the driver collects to train on is at most 4 bytes a feature, and gives the same shares as a plain count."""
    from atlasweave.llm import _hashed

    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(["und", "the", "Wort", "Xy!", "42"], 60)) + str(k) for k in range(30)] + ["aaab" * 70_000 + " und the end of it"]
    df = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    for module, name, lower in ((language_id, "fit", True), (weak_quality, "fit_scorer", False)):
        got, sizes = [], []
        with monkeypatch.context() as m:
            m.setattr(module, name, lambda found, fit=getattr(module, name), got=got: got.extend(found) or fit(found))
            m.setattr(type(df), "collect", lambda self, f=type(df).collect, sizes=sizes: sizes.extend(out := f(self)) or out)
            module.train(df)
        plain = {}
        for t in texts:
            b = np.frombuffer((t.lower() if lower else t).encode(), np.uint8)
            at, c = np.unique(np.concatenate([_hashed.grams(b, module.BITS, n) for n in _hashed.ORDERS]), return_counts=True)
            plain[tuple(at.tolist())] = (c / c.sum()).astype(np.float32).tolist()
        assert len(got) == len(texts) and {tuple(x[-2].tolist()): x[-1].tolist() for x in got} == plain
        features = sum(map(len, plain))
        wide = 6 * max(map(len, (k for k, v in plain.items() if max(v) > 0.1)))  # counts beyond 16 bits
        sent = sum(len(r["ids"]) + len(r["counts" if "counts" in r else "shares"]) for r in sizes if "ids" in r)
        assert 0 < sent <= 4 * features + wide


def test_language_id(docs, data, nothing):
    got = by_id(language_id.language_ids(docs))
    assert sum(map(len, got.values())) == len(data)
    for i in (300, 301, 302, 310):
        assert all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in got[i])
    long = [(r, next(x[2] for x in data if x[0] == i)) for i, rs in got.items() if i is not None and i < 120 and i % 10 in (8, 9) for r in rs if r["held_out"]]
    assert long and sum(r["lang_pred"] == lang for r, lang in long) >= 0.9 * len(long)
    assert all(0 <= r["score"] <= 1 for rs in got.values() for r in rs)
    assert language_id.language_ids(nothing).count() == 0
    assert {r["lang_pred"] for r in language_id.language_ids(docs.withColumn("lang", docs["lang"].substr(1, 0))).collect()} <= {"und", ""}


def test_language_id_on_tables(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_ids(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got) and sum(not r["accepted"] for r in got) <= 0.02 * len(got)


def test_quality_classifier(docs, data, nothing):
    got = by_id(weak_quality.quality(docs))
    assert sum(map(len, got.values())) == len(data)
    assert not any(r["accepted"] for i in (300, 301, 302, 307) for r in got[i])
    assert weak_quality.quality(nothing).count() == 0


def test_quality_classifier_on_tables(spark):
    d = "/root/testdata/sf0.01"
    got = weak_quality.quality(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet").withColumnRenamed("quality", "label"), "doc_id").collect()
    good, bad = [r["accepted"] for r in got if r["label"]], [r["accepted"] for r in got if not r["label"]]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_expectation_maximisation_finds_the_noisy_labeller():
    rng = random.Random(2)
    patterns = collections.Counter()
    for _ in range(4000):
        good = rng.random() < 0.7
        v = [2 if (good if rng.random() < a else not good) else 1 for a in (0.95, 0.9, 0.9, 0.55, 0.9, 0.9, 0.9)]
        patterns[sum(x * 3**k for k, x in enumerate(v))] += 1
    _, found = weak_quality.expectation_maximisation(patterns)
    acc = {k: (x["good"] + x["bad"]) / 2 for k, x in found["accuracy"].items()}
    assert abs(found["good_share"] - 0.7) < 0.05 and min(acc, key=acc.get) == weak_quality.NAMES[3]


# 6


def test_decontamination(spark):
    d = spark.createDataFrame(
        [
            (1, "Some intro. Question: a farmer called John has 12 apples and gives 5 apples to Mary who then walks 3 km back home with John today. End.", 9),
            (2, "nothing at all, of, the, kind here Mary", 9),
            (3, "a farmer called Peter has 17 apples and gives 6 apples to Ann who then walks 9 miles back home with Peter today", 9),
            (4, "a farmer called Peter has 17 apples and gives 6 apples to Ann who then walks 9 miles back home with Carl today", 9),
            (5, None, 9), (None, "a farmer called John has 12 apples and gives 5 apples to Mary who then walks 3 km back home with John today", 9), (6, "", 9), (7, "1 2 3 4 5 6 7 8 9 10 11 12 13 14", 9),
        ],
        "doc_id long, text string, item_id long",
    )
    b = spark.createDataFrame([(10, "A farmer called John has 12 apples and gives 5 apples to Mary who then walks 3 km back home with John today."), (11, "Tiny item"), (12, "of the kind here"), (13, None), (None, "x y z w v"), (14, "9 8 7 6 5 4 3 2 1 9 8 7")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontamination.contaminated(d.union(d.limit(1)), b).collect()}
    assert set(got) == {(1, 10), (2, 12), (3, 10)}
    assert got[3, 10]["n_changed"] == 7 and got[1, 10]["n_changed"] == 0
    assert decontamination.contaminated(d.limit(0), b).count() == 0 and decontamination.contaminated(d, b.limit(0)).count() == 0


def test_decontamination_of_items_without_literal_windows(spark):
    numbers = " ".join(str(k * k) for k in range(40))
    items = [(1, "What is 15 percent of 80?"), (2, "Is 91 a prime number?"), (3, "9 8 7 6 5 4 3 2 1 9 8 7"), (4, "Tiny item"), (5, "So Anna, Bert, Carl, Dora, Emil and Finn"), (6, numbers), (7, "?!"), (8, "42"), (1, "a second text of item one that is told by its template")]
    docs = [
        (1, "Quiz.\nWhat is 15 percent of 80?\nNext."), (2, "What is 20 percent of 90?"), (3, "Is 91 a prime number? No."), (4, "Is 97 a prime number? Yes."), (5, "digits: 9 8 7 6 5 4 3 2 1 9 8 7 end"), (6, "digits: 9 8 7 6 5 4 3 2 1 9 8"),
        (7, "digits: 9 8 7 6 5 4 3 2 1 0 8 7"), (8, "one tiny item here"), (9, "tiny other item"), (10, "so anna, bert, carl, dora, emil and finn"), (11, "So Anna, Bert, Carl, Dora, Emil and Gina"), (12, f"list {numbers} end"), (13, "and a second text of item one that is told by its template"), (14, "4 2 424"), (15, None),
    ]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontamination.contaminated(d, b).collect()}
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 3), (8, 4), (10, 5), (12, 6), (13, 1)}
    assert got[5, 3] == (5, 5, 12, 0) and got[6, 3][:2] == (4, 5) and got[12, 6][:2] == (33, 33)
    alone = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(d, b.where("item_id IN (4, 8)")).collect()}
    assert alone == {(8, 4)}


def test_decontamination_of_copies_inside_a_line(spark):
    items = [(1, "Where does the old river begin?"), (2, "days of the week are seven in number"), (3, "Which of these four planets has the most moons around it?")]
    before = ["", "Quiz. ", "Q - ", "as asked, ", "tab\t", "(", 'he said: "', 'he said "no." ']
    docs = [(100 * n + k, b + text) for n, text in items for k, b in enumerate(before)] + [(208, "12) " + items[1][1]), (209, "Where did the old river begin?"), (210, "see, Where does the new river begin?"), (211, "then Which does the old river begin?")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontamination.contaminated(d, b).collect()}
    assert set(got) == {(100 * n + k, n) for n, _ in items for k in range(len(before))} | {(208, 2)}
    assert all(r[0] == r[1] for r in got.values())


def plain_template(text):
    """(template token, lower-cased word) of a text, word by word."""
    t = re.sub(r"([0-9])[.,]([0-9])", r"\1\2", text)
    t = re.sub(r"[.!?:]+\s|\n", " \x01 ", t)
    raw = [w for w in re.split("[^\x01A-Za-z0-9äöüß]+", t) if w]
    out = []
    for i, w in enumerate(raw):
        if w == "\x01":
            continue
        low, before = w.lower(), raw[i - 1] if i else None
        if w.isdigit():
            kind = "#number"
        elif w[0] != low[0] and i and before != "\x01":
            kind = "#name"
        elif before and before[0].isdigit() and low in decontamination.UNITS:
            kind = "#unit"
        else:
            kind = low
        out.append((kind, low))
    return out


def plain_contaminated(docs, items):
    """Every window of every item at every place of every document, then slot by slot."""
    found = set()
    for i, item in items:
        own = plain_template(item)
        width = min(len(own), decontamination.WINDOW)
        if not width:
            continue
        starts = range(len(own) - width + 1)
        need = min(decontamination.LITERALS, width)
        literal = [s for s in starts if sum(t[0] != "#" for t, _ in own[s : s + width]) >= need] if width >= decontamination.SHORT else []
        copied = not literal
        windows = list(starts) if copied else literal
        for d, text in docs:
            theirs = plain_template(text or "")
            lines = collections.defaultdict(set)
            for s in windows:
                for p in range(len(theirs) - width + 1):
                    mine, other = own[s : s + width], theirs[p : p + width]
                    if copied:
                        same = [v for _, v in mine] == [v for _, v in other]
                    else:
                        same = all(a == b for (a, _), (b, _) in zip(mine[1:], other[1:])) and (mine[0][0] == other[0][0] or other[0][0] in ("#name", "#unit") and mine[0][0] == other[0][1])
                    if same:
                        lines[p - s].add(s)
            covered = set()
            for shift, at in lines.items():
                forth, back = collections.defaultdict(set), collections.defaultdict(set)
                for k in range(min(at), max(at) + width):
                    if 0 <= k + shift < len(theirs) and own[k][0][0] == "#" and own[k][0] == theirs[k + shift][0]:
                        forth[own[k]].add(theirs[k + shift][1])
                        if own[k][0] == "#name":
                            back[theirs[k + shift][1]].add(own[k][1])
                if copied or all(len(x) == 1 for x in [*forth.values(), *back.values()]):
                    covered |= at
            if covered and (100 * len(covered) >= decontamination.COVERAGE * len(windows) or len(covered) >= decontamination.RUN):
                found.add((d, i))
    return found


def test_decontamination_against_a_plain_matcher(spark):
    rng = random.Random(12)
    names, units = "Anna Bert Carl Dora Emil".split(), "km kg days cm".split()

    def sentence(n):
        words = []
        for _ in range(n):
            k = rng.random()
            words.append(rng.choice(names) if k < 0.15 else f"{rng.randint(1, 30)} {rng.choice(units)}" if k < 0.3 else str(rng.randint(1, 9)) if k < 0.4 else rng.choice("the of walks with gives apples from to and back home".split()))
        return " ".join(words)

    def altered(text):
        to = dict(zip(names, rng.sample(names, len(names)) if rng.random() < 0.7 else [rng.choice(names) for _ in names]))
        up = rng.randint(0, 3)
        out = [to.get(w, str(int(w) + up) if w.isdigit() and rng.random() < 0.98 else w) for w in text.split()]
        if rng.random() < 0.3:
            out[rng.randrange(len(out))] = "other"
        return " ".join(out)

    items = [(i, sentence(rng.choice([1, 3, 6, 8, 12, 20, 45])).capitalize()) for i in range(30)]
    docs = []
    for d in range(240):
        i, text = rng.choice(items)
        body = altered(text) if rng.random() < 0.8 else text
        docs.append((d, rng.choice(["", "Intro text. ", "so, "]) + sentence(rng.randint(0, 6)) + rng.choice([" ", ". ", ", ", "\n"]) + body + rng.choice(["", ". ", " and "]) + sentence(rng.randint(0, 30))))
    docs += [(1000, " ".join(x for _, x in docs) * 3), (1001, "")]  # a long text that holds all
    want = plain_contaminated(docs, items)
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == sorted(want) and 50 < len(want) and any(d not in {x for x, _ in want} for d, _ in docs[:240])


def test_decontamination_finds_every_planted_item(spark):
    """Verbatim, with numbers, of three words, and in German, where nouns look like names."""
    items = ["What is 12 times 7 plus 5?", "Compute 17 + 25 - 9 * 4 for x", "who wrote it?", "Welche Stadt liegt am Fluss Spree und ist die Hauptstadt?", "How many apples do 5 boys and 6 girls have if each has 3?", "Die Katze, der Hund, das Pferd und die Kuh", "Name Name Name"]
    docs = [(k, f"Some page with text. {t}\nMore of it.") for k, t in enumerate(items)] + [(100 + k, f"and inside of a line, {t} more") for k, t in enumerate(items)] + [(200, "nothing here of the kind")]
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    assert {(k, k) for k in range(len(items))} | {(100 + k, k) for k in range(len(items))} <= got and all(d % 100 == i for d, i in got)


def test_decontamination_on_tables(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    flat = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    held = [(r["doc_id"], f" {flat(r['text'])} ") for r in docs.collect()]
    want = {(i, b["item_id"]) for b in bench.collect() for i, t in held if f" {flat(b['text'])} " in t}
    assert want and want <= got and {i for i, _ in got} == {i for i, _ in want}


# 9


def test_license_scan(docs, data, nothing, spark):
    extra = [(900, "Licensed under CC BY-NC 4.0. All rights RESERVED, cc by; GNU General Public License, version 3."), (901, license_scan.TEMPLATES["mit"].replace("<<beginOptional>>", "").replace("<<endOptional>>", "") + " and more"), (902, license_scan.TEMPLATES["mit"].replace("free of charge", "for a charge")), (903, "cc bye all rights")]
    table = docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string"))
    got = by_id(license_scan.license_labels(table))
    for i, t in [*texts(data).items(), *extra]:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        places = sorted((k, label) for phrase, label in license_scan.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        for r in got[i]:
            assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(places), ",".join(sorted({x for _, x in places}))), i
            assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    assert got[901][0]["labels"] == "mit" and got[902][0]["labels"] == "" and got[900][0]["labels"] == "cc-by,cc-by-nc,gpl,gpl-3.0,reserved"
    assert license_scan.license_labels(nothing).count() == 0


def test_template_automaton():
    a = license_scan.Automaton('alpha <<beginOptional>>beta gamma<<endOptional>> <<var;words="1-2">> omega')
    match = lambda t: a.match(license_scan.words_of(t), 0)
    assert [match(t) for t in ("alpha x omega", "Alpha, beta gamma x y omega!", "alpha omega", "alpha beta x y omega", "alpha beta omega", "alpha x y z omega", "alpha x omega omega")] == [3, 6, -1, -1, 3, -1, 4]


def plain_pattern(template):
    """The template as a regular expression over words with a space behind each."""
    out, pos = "", 0
    for m in [*license_scan._MARKUP.finditer(template), None]:
        words = license_scan.words_of(template[pos : m.start() if m else len(template)])
        out += "".join(re.escape(w.decode()) + " " for w in words)
        if m:
            out += "(?:" if m[1] == "beginOptional" else ")?" if m[1] == "endOptional" else rf"(?:[^ ]+ ){{{m[2]},{m[3]}}}"
            pos = m.end()
    return re.compile(out)


def test_templates_against_regular_expressions():
    """All templates on texts made from their markup, whole and damaged."""
    rng = random.Random(6)
    automata = {k: license_scan.Automaton(t) for k, t in license_scan.TEMPLATES.items()}
    patterns = {k: plain_pattern(t) for k, t in license_scan.TEMPLATES.items()}
    hits = collections.Counter()
    for label, template in license_scan.TEMPLATES.items():
        for _ in range(12):
            text = re.sub("<<beginOptional>>(.*?)<<endOptional>>", lambda m: m[1] if rng.random() < 0.5 else "", template)
            text = re.sub(r'<<var;words="(\d+)-(\d+)">>', lambda m: " ".join(rng.choice(["Some", "One", "x1", "über"]) for _ in range(rng.randint(int(m[1]), int(m[2])))), text)
            words = license_scan.words_of(text)
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = b"damaged"
            words = [b"before"] * rng.randint(0, 2) + words + [b"after"] * rng.randint(0, 2)
            _, _, found = license_scan.scan(b" ".join(words).decode(), automata)
            # each automaton starts at its leading mandatory words
            flat = [w.decode() + " " for w in words]
            for other, a in automata.items():
                lead = a.lead.decode().strip().split()
                want = []
                for s in range(len(words)):
                    if [x.strip() for x in flat[s : s + len(lead)]] == lead:
                        tail = patterns[other].pattern
                        tail = tail[tail.index("".join(re.escape(x) + " " for x in lead)) :]
                        depth = tail.count(")") - tail.count("(")
                        ends = [e for e in range(s + 1, len(words) + 1) if re.fullmatch("(?:" * max(0, depth) + tail, "".join(flat[s:e]))]
                        want += [(s, max(ends), other)] if ends else []
                assert [x for x in found if x[2] == other] == want, (label, other)
            hits[label] += any(x[2] == label for x in found)
    assert all(hits[k] for k in license_scan.TEMPLATES), [k for k in license_scan.TEMPLATES if not hits[k]]


# 10

PAGES = [
    ("<html><head><title>no</title></head><body><header><h1>Site</h1></header><div id='sidebar-left'><p>Side text, long, with commas, and more text here to score</p></div><div class='content'><h1>T &amp; t</h1><div><p>First para, with commas, and text  long enough.</p><p>Second <b>bold</b>\npara.</p><ul><li>one<li>two</ul><div class=share-buttons>share</div><div class=ad>Buy</div></div></div><section id=comments><p>Nice, comment, from, reader, that, is, long</p></section><footer>f</footer>", "T & t\n\nFirst para, with commas, and text long enough.\n\nSecond bold para.\n\none\n\ntwo"),
    ("<article><h1>A</h1><p><b>one<br><p>two &lt;x&gt;</p><script>var p='</p>';</script><form><p>mail</p></form><p>three</article><footer>&copy;", "A\n\none\n\ntwo <x>\n\nthree"),
    ("<nav>x</nav>", ""), ("", ""), (None, ""), ("plain &lt;text&gt; only", "plain <text> only"), ("<p>cut off in a tag <a href='x", "cut off in a tag"), ("<p class=ad>no<p>yes it is, text", "yes it is, text"), ("<div>" * 5000 + "<p>deep</p>", "deep"),
    ("<div hidden><p>unseen, text, here</p></div><main><p>seen</p></main><div role=banner>b</div>", "seen"),
    # several articles, alone and in the main part
    ("<article><h1>A</h1><p>First, one</p></article><article><h1>B</h1><p>Second one, with more text, and more</p></article><footer>f</footer>", "A\n\nFirst, one\n\nB\n\nSecond one, with more text, and more"),
    ("<main><article><p>First</p></article><article><p>Second, one</p></article><aside>no</aside></main>", "First\n\nSecond, one"),
    # names that hold a word of a menu, advert or notice
    ("<article><p class='copyright-law'>a1</p><div class='survey-results'>a2</div><p class=extra>a3</p><p class=remark>a4</p><section class=community><p>a5</p></section><p id=share-price>a6 <math><mi>y</mi></math></p><div class='with-sidebar'>a7</div></article>", "a1\n\na2\n\na3\n\na4\n\na5\n\na6 y\n\na7"),
    ("<article><p>yes</p><div class='share-buttons'>no</div><div class='share-tools'><a>no</a></div><div class='share-facts'>facts</div><section id=comments><article class=comment><p>no, no, no, no</p></article></section><div class=cookie-notice>no</div></article>", "yes\n\nfacts"),
    ("<div class='sidebar-layout'><main><p>held</p></main></div>", "held"), ("<div class='share-price menu-card'><article><p>held</p></article></div>", "held"),
    # a form around the page, and one in it
    ("<form id=f><div class=content><h1>T</h1><p>One, two</p><p>Three</p><p>Four</p><form><p>mail</p></form></div></form>", "T\n\nOne, two\n\nThree\n\nFour"),
    ("<div>" * 50_000 + "<p>deep</p>" + "</div>" * 50_000 + "<nav>" * 50_000, "deep"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, "u", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(0, "u", PAGES[0][0], "clash")], "page_id long, url string, html string, text string")
    got = html_text.extract_pages(df).collect()
    assert len(got) == len(PAGES) + 1
    for r in got:
        assert r["text"] == PAGES[r["page_id"]][1] and r["n_chars"] == len(r["text"]), r["page_id"]
    assert html_text.extract_pages(df.limit(0)).count() == 0


def test_html_on_pages(spark):
    """On the given pages, against a plain reading of their own article element."""
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_text.extract_pages(pages).collect()
    assert len(got) == len(raw) > 100
    for r in got:
        inside = re.search("<article>(.*?)</article>", raw[r["page_id"]], re.S)[1]
        inside = re.sub("<(form|aside|nav|script|style)\\b.*?</\\1>|<!--.*?-->", "", inside, flags=re.S)
        parts = (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x.replace("<br>", " ")))).strip() for x in re.split("</?(?:p|h1|h2|li|ul|div)>", inside))
        assert r["text"] == "\n\n".join(x for x in parts if x), r["page_id"]


def test_html_is_linear():
    def seconds(n):
        at = time.perf_counter()
        html_text.main_text("<div><p><b>" * n + "deep")
        return time.perf_counter() - at

    assert seconds(40_000) < 40 * max(0.01, seconds(4_000)) and seconds(40_000) < 5
