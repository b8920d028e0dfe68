"""The pipeline against plain versions of its stages."""

import hashlib

import corpus_pipeline
from atlasweave.llm import weak_quality
from test_operators import brute_components


def test_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names, outs = [n for n, _ in corpus_pipeline.STAGES], []
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, d).write.parquet(path := str(tmp_path / name))
        kept = spark.read.parquet(path)
        outs.append(kept.collect())
        if name != names[-1]:
            assert kept.columns == docs.columns
    ids = [{r["doc_id"] for r in o} for o in outs]
    accepted = {r["doc_id"] for r in weak_quality.quality(docs).where("accepted").collect()}
    assert ids[0] == accepted and ids[1] <= ids[0]
    groups = brute_components({r["doc_id"]: r["text"] for r in outs[1]}, 5, 80)
    assert ids[2] == {c for _, c in groups.values()}
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    leaks = {r["doc_id"] for r in outs[2] if any(i in " ".join(r["text"].split()) for i in items)}
    assert leaks and ids[3] == ids[2] - leaks == ids[4]
    text = {r["doc_id"]: r["text"] for r in outs[3]}
    assert all(r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest() for r in outs[4])
    assert {tuple(r) for r in corpus_pipeline.run(spark, d).collect()} == {tuple(r) for r in outs[4]}


def test_odd_rows(spark):
    rows = [(1, None, None, "s", 0, True), (None, "a text without an id but with words enough to pass", "en", "s", 1, True), (2, "", "en", "s", 0, False), (3, "A fine text with words enough to pass the rules, and one more.", "en", None, None, None)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long, accepted boolean")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        assert 3 in {r["doc_id"] for r in out.collect()}, name
    one = [r for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect() if r["doc_id"] == 3]
    assert len(one) == 1
