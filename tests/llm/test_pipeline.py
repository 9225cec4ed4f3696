"""The pipeline, stage by stage, against the operators' own brute-force rules."""

import re

import corpus_pipeline
from chorus.llm import pii

SMALL = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "jaccard", "benchmark", "pii", "packing"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        step(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = {r.doc_id for r in seen["quality"]}
    good = [d for d, q in labels.items() if q == 1]
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in good) >= 0.95 * len(good) and sum(d in kept for d in bad) <= 0.1 * len(bad)

    def shingles(text, width, words):
        w = re.findall(words, text.lower())
        return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    left = [(r.doc_id, shingles(r.text, 5, r"[^\x20\x09-\x0D]+")) for r in seen["jaccard"]]
    for k, (_, a) in enumerate(left):
        for _, b in left[:k]:
            same = len(a & b)
            assert not a or 100 * same < 80 * (len(a) + len(b) - same)
    items = [shingles(r.text, 5, r"[^\W_]+") for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for r in seen["benchmark"]:
        have = shingles(r.text, 5, r"[^\W_]+")
        assert not any(10 * len(i & have) >= 8 * len(i) for i in items)
    assert len(seen["pii"]) == len(seen["benchmark"])
    for r in seen["pii"]:
        assert pii.base_spans(r.text)[0] == [] and r.n_chars == len(r.text)
    assert {r.doc_id for r in seen["packing"]} == {r.doc_id for r in seen["pii"]}


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "start", "length", "sequence_id", "offset", "ids_crc32"} <= set(rows.columns)
    assert rows.count() > 0


def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, docs, SMALL)
            out.collect()
            assert name == "packing" or out.columns == docs.columns


def test_stages_judge_rows_not_ids(spark):
    def text(word, n=30):
        return " ".join(f"{word}{k}" for k in range(n))

    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("length(text) > 60").first().text
    rows = [(2, text("b")), (5, text("a")), (5, text("b")), (9, text("a")), (None, text("c")), (None, text("c")),
            (None, text("b")), (7, text("d")), (7, text("e")), (7, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    left = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(((r.doc_id, r.text[0]) for r in left), key=str) == [(2, "b"), (5, "a"), (7, "d"), (7, "e"), (None, "c")]
    rows = [(1, item), (1, text("a")), (None, item), (None, text("b"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    left = corpus_pipeline.benchmark(spark, docs, SMALL).collect()
    assert sorted(((r.doc_id, r.text[0]) for r in left), key=str) == [(1, "a"), (None, "b")]
