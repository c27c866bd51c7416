from __future__ import annotations

import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe import (
    embeddings_or_compute,
    hybrid_pipeline,
    rerank_from_embeddings,
    rrf,
    run_snapshots,
    snapshot_runs,
    token_jaccard,
    weighted_fusion,
)
from rankframe.operators.encoding import model_encoder, scores_or_compute
from rankframe.sources.readers import read_trec_run

WORDS = ["solar", "wind", "cell", "film", "grid", "tide", "ocean", "heat"]


def load_counts():
    def predict(texts):
        return np.array([[text.count(w) for w in WORDS] for text in texts], dtype=np.float32)

    return predict


ENCODER = model_encoder(load_counts, batch_size=16)


def write_dataset(root, name, n):
    docs = root / "documents" / f"snapshot={name}"
    docs.mkdir(parents=True)
    lines = [
        {"id": f"{i:03}", "title": WORDS[i % 8].upper(), "abstract": " ".join(WORDS[: 1 + i % 5]) if i % 4 else None}
        for i in range(n)
    ]
    (docs / "part.jsonl").write_text("\n".join(map(json.dumps, [*lines, {"id": "blank", "title": " "}])) + "\n")
    asked = root / "queries" / f"snapshot={name}"
    asked.mkdir(parents=True)
    (asked / "queries.tsv").write_text("q1\tSolar cell\nq2\t ocean tide \n")


def run_files(out):
    return {str(f.relative_to(out)): f.stat().st_mtime_ns for f in out.rglob("part-*.gz")}


def test_snapshots_run_once_and_go_on(spark, tmp_path):
    root, out = tmp_path / "data", tmp_path / "runs"
    write_dataset(root, "2024-11", 30)
    run_snapshots(spark, str(root), str(out), ENCODER, token_jaccard, k=10)
    first = run_files(out)
    assert first and all(name.startswith("snapshot=2024-11/") for name in first)
    lines = gzip.decompress((out / sorted(first)[0]).read_bytes()).decode().splitlines()
    assert lines[0].split()[1] == "Q0" and lines[0].endswith(" e5-reranked")

    write_dataset(root, "2025-01", 12)
    run_snapshots(spark, str(root), str(out), ENCODER, token_jaccard, k=10)
    both = run_files(out)
    assert {k: v for k, v in both.items() if k in first} == first
    run = read_trec_run(spark, str(out / "snapshot=2025-01"))
    assert run.groupBy("qid").agg(F.count("*").alias("n"), F.max("rank").alias("last")).collect() == [
        ("q1", 10, 10), ("q2", 10, 10),
    ] or run.count() == 20
    run_snapshots(spark, str(root), str(out), ENCODER, token_jaccard, k=10)
    assert run_files(out) == both
    stored = spark.read.parquet(f"{out}-vectors")
    assert stored.count() == 42 and stored.select("snapshot", "docid").distinct().count() == 42


def test_small_snapshot_returns_all_its_documents(spark):
    docs = spark.createDataFrame([("s", "a", "Solar cell", None), ("s", "b", "wind", "x")], "snapshot string, docid string, title string, abstract string")
    stored = docs.select("snapshot", "docid", F.array(F.length("title").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    stored = stored.unionByName(stored.limit(1).withColumn("docid", F.lit("gone")))
    asked = spark.createDataFrame([("s", "q", " SOLAR query: cell", [1.0, 0.0]), ("t", "r", "x", [1.0, 0.0])], "snapshot string, qid string, query string, embedding array<float>")
    run = snapshot_runs(docs, asked, stored, token_jaccard, 100)
    assert [tuple(r) for r in run.orderBy("qid", "rank").collect()] == [
        ("s", "q", "a", 1.0, 1), ("s", "q", "b", 0.0, 2), ("s", "q", "gone", 0.0, 3),
    ]


def test_only_missing_vectors_are_encoded(spark, tmp_path):
    docs = spark.createDataFrame([("a", "solar"), ("b", "wind")], "docid string, text string")
    path = str(tmp_path / "vectors")
    assert embeddings_or_compute(docs, path, ENCODER).count() == 2
    more = docs.unionByName(spark.createDataFrame([("c", "tide")], "docid string, text string"))

    def never(column):
        return F.when(F.col("docid") == "c", ENCODER(column)).otherwise(F.raise_error(F.lit("encoded again")).cast("array<float>"))

    stored = embeddings_or_compute(more, path, never)
    assert sorted(r["docid"] for r in stored.collect()) == ["a", "b", "c"]
    assert embeddings_or_compute(more, path, never).count() == 3


def test_hybrid_is_its_parts(spark, rows):
    schema = "qid string, docid string, score double, rank int"
    runs = [
        spark.createDataFrame([("q", "a", 0.9, 1), ("q", "b", 0.8, 2)], schema),
        spark.createDataFrame([("q", "b", 0.9, 1), ("q", "c", 0.8, 2)], schema),
        spark.createDataFrame([("q", "d", 9.0, 1)], schema),
    ]
    queries = spark.createDataFrame([("q", "solar cell")], "qid string, query string")
    docs = spark.createDataFrame([("a", "wind"), ("b", "solar"), ("c", "solar cell")], "docid string, text string")
    qrels = spark.createDataFrame([("q", "c", 1)], "qid string, docid string, relevance int")
    for depth in (2, None):
        out = hybrid_pipeline(runs, queries, docs, qrels, token_jaccard, depth=depth)
        assert rows(out.fused) == rows(weighted_fusion(runs, (0.8, 0.1, 0.1), depth=2))
        assert rows(out.rrf) == rows(rrf(runs, depth=2))
        assert rows(out.reranked, "docid", "rank") == [("a", 3), ("b", 2), ("c", 1)]
        assert out.ndcg.first()["ndcg"] == 1.0


def test_rerank_from_vectors_keeps_unknown_documents(spark):
    stored = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 0.0]), ("c", 2, [0.0, 1.0])], "docid string, position int, embedding array<float>")
    asked = spark.createDataFrame([("q", "solar", [1.0, 0.0])], "qid string, query string, embedding array<float>")
    docs = spark.createDataFrame([("b", "solar")], "docid string, text string")
    run = rerank_from_embeddings(asked, stored, docs, token_jaccard, 1, position="position")
    assert [tuple(r) for r in run.collect()] == [("q", "b", 1.0, 1)]
    run = rerank_from_embeddings(asked, stored, docs, token_jaccard, 3)
    assert [r["docid"] for r in run.orderBy("rank").collect()] == ["b", "a", "c"]


def counted_scorer(calls):
    """A scorer that counts the pairs it is asked for."""

    @F.udf("double")
    def score(query, text):
        calls.add(1)
        return float(len(text) - len(query))

    return score


def test_pairs_of_texts_are_scored_once(spark, tmp_path, rows):
    path = str(tmp_path / "scores")
    texts = [("q1", "a", "x", "long"), ("q2", "b", "x", "long"), ("q1", "c", "x", ""), ("q1", "d", "xl", "ong")]
    pairs = spark.createDataFrame(texts * 2, "qid string, docid string, query string, text string")
    calls = spark.sparkContext.accumulator(0)
    want = sorted([("q1", "a", 3.0), ("q2", "b", 3.0), ("q1", "c", -1.0), ("q1", "d", 1.0)] * 2)
    assert rows(scores_or_compute(pairs, path, counted_scorer(calls))) == want and calls.value == 3
    more = pairs.unionByName(spark.createDataFrame([("q3", "e", "y", "z")], pairs.schema))
    assert rows(scores_or_compute(more, path, counted_scorer(calls))) == sorted([*want, ("q3", "e", 0.0)]) and calls.value == 4


def test_changed_texts_get_new_vectors(spark, tmp_path, rows):
    path = str(tmp_path / "vectors")
    docs = spark.createDataFrame([("a", "solar"), ("b", "wind")], "docid string, text string")
    embeddings_or_compute(docs, path, ENCODER)
    changed = docs.withColumn("text", F.when(F.col("docid") == "a", "tide tide").otherwise(F.col("text")))
    found = {r["docid"]: list(r["embedding"]) for r in embeddings_or_compute(changed, path, ENCODER).collect()}
    assert found["a"][WORDS.index("tide")] == 2.0 and found["a"][0] == 0.0 and found["b"][1] == 1.0
    before = {r["docid"]: list(r["embedding"]) for r in embeddings_or_compute(docs, path, lambda c: F.raise_error(F.lit("again")).cast("array<float>")).collect()}
    assert before["a"][0] == 1.0


def test_vectors_without_a_fingerprint_are_made_anew(spark, tmp_path):
    path = str(tmp_path / "vectors")
    docs = spark.createDataFrame([("a", "solar")], "docid string, text string")
    spark.createDataFrame([("a", [9.0])], "docid string, embedding array<float>").write.parquet(path)
    assert [len(r["embedding"]) for r in embeddings_or_compute(docs, path, ENCODER).collect()] == [8]
