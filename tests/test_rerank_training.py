from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe import hydrate, judged_plus_noise, model_scorer, rerank, training_batches, training_pairs
from rankframe.functions import ranking
from rankframe.operators import training
from rankframe.operators.training import in_batch_negatives


@pytest.fixture(scope="module")
def tables(spark):
    run = spark.createDataFrame([("q1", "a"), ("q1", "b"), ("q1", "gone"), ("q2", "a"), ("lost", "a")], "qid string, docid string")
    queries = spark.createDataFrame([("q1", "One x"), ("q2", "two")], "qid string, query string")
    docs = spark.createDataFrame([("a", "One y z"), ("b", "x One"), ("c", "unused")], "docid string, text string")
    return run, queries, docs


def test_hydrate(tables, rows):
    run, queries, docs = tables
    there = [("q1", "a", "One x", "One y z"), ("q1", "b", "One x", "x One"), ("q2", "a", "two", "One y z")]
    assert rows(hydrate(run, queries, docs)) == there
    assert rows(hydrate(run, queries, docs, "blank")) == sorted([*there, ("q1", "gone", "One x", "")])
    with pytest.raises(ValueError):
        hydrate(run, queries, docs, "keep")


def load_overlap():
    def predict(queries, texts):
        return np.array([len(set(q.split()) & set(t.split())) for q, t in zip(queries, texts)], dtype=np.float64)

    return predict


@pytest.mark.parametrize("depth", [3, None])
def test_rerank_with_a_model(tables, depth):
    run, queries, docs = tables
    got = rerank(run, queries, docs, model_scorer(load_overlap), "blank", depth=depth).orderBy("qid", "rank")
    assert [tuple(r) for r in got.collect()] == [
        ("q1", "b", 2.0, 1), ("q1", "a", 1.0, 2), ("q1", "gone", 0.0, 3), ("q2", "a", 0.0, 1),
    ]


def test_rerank_with_lowercased_query(tables):
    run, queries, docs = tables
    got = rerank(run, queries, docs, lambda q, t: F.instr(t, F.lit("One")) * F.length(q), query_format=F.lower, depth=3)
    assert {r["score"] for r in got.collect()} == {5.0, 25.0, 3.0} or got.count() == 3


def test_training_pairs(spark, tables, rows):
    _, queries, docs = tables
    qrels = spark.createDataFrame([("q1", "a", 2), ("q1", "b", 0), ("q1", "zz", 1), ("qq", "a", 1)], "qid string, docid string, relevance int")
    got = training_pairs(qrels, queries.withColumn("query", F.concat("query", F.lit(" \n"))), docs)
    assert rows(got) == [("q1", "a", "query: One x", "passage: One y z")]


def test_batches_number_every_row_once(spark, monkeypatch):
    monkeypatch.setattr(training, "COPIES_PER_STEP", 7)
    rows = [(f"q{i % 13}", f"d{i}") for i in range(200)] + [("q1", "copy")] * 100
    pairs = spark.createDataFrame(rows, "qid string, docid string")
    got = training_batches(pairs, 8, seed=4).orderBy("position").collect()
    want = sorted(rows, key=lambda r: (hashlib.md5(f"4|{r[0]}|{r[1]}".encode()).hexdigest(), r))
    assert [(r["qid"], r["docid"]) for r in got] == want
    assert [r["position"] for r in got] == list(range(300))
    assert [r["batch"] for r in got] == [i // 8 for i in range(300)]
    again = training_batches(pairs.repartition(5), 8, seed=4).orderBy("position").collect()
    assert again == got and training_batches(pairs, 8, seed=5).orderBy("position").collect() != got


def test_negatives_are_the_rest_of_the_batch(spark):
    pairs = spark.createDataFrame([("q", f"d{i}") for i in range(20)], "qid string, docid string")
    got = in_batch_negatives(training_batches(pairs, 8)).orderBy("position").collect()
    for row in got:
        mates = [r["docid"] for r in got if r["batch"] == row["batch"]]
        assert row["negatives"] == [d for d in mates if d != row["docid"]]


@pytest.mark.parametrize("digits", [1, 3])
@pytest.mark.parametrize("n", [0, 1, 17, 500])
def test_noise_is_the_first_by_hash(spark, monkeypatch, n, digits):
    for module in (ranking, training):
        monkeypatch.setattr(module, "HASH_DIGITS", digits)
    docs = spark.createDataFrame([(f"d{i}", i) for i in range(300)], "docid string, x int")
    qrels = spark.createDataFrame([("q", f"d{i}") for i in range(0, 300, 30)] + [("q", "gone")], "qid string, docid string")
    judged = {f"d{i}" for i in range(0, 300, 30)}
    others = sorted(({f"d{i}" for i in range(300)} - judged), key=lambda d: hashlib.md5(f"9|{d}".encode()).hexdigest())
    got = judged_plus_noise(docs, qrels, n, seed=9)
    assert {r["docid"] for r in got.collect()} == judged | set(others[:n]) and got.columns == docs.columns


def test_small_scores_keep_their_order(spark):
    scores = {"a": 1e-8, "b": 2e-7, "c": 3e-7}
    run = spark.createDataFrame([("q", d) for d in scores], "qid string, docid string")
    queries = spark.createDataFrame([("q", "x")], "qid string, query string")
    docs = spark.createDataFrame([(d, str(s)) for d, s in scores.items()], "docid string, text string")
    ranked = rerank(run, queries, docs, lambda query, text: text.cast("double")).orderBy("rank").collect()
    assert [(r["docid"], r["score"]) for r in ranked] == [("c", 3e-7), ("b", 2e-7), ("a", 1e-8)]


def test_rerank_without_a_usable_pair_is_an_error(spark):
    run = spark.createDataFrame([("q", "1.0")], "qid string, docid string")
    queries = spark.createDataFrame([("q", "x")], "qid string, query string")
    docs = spark.createDataFrame([("1", "text")], "docid string, text string")
    with pytest.raises(ValueError, match="ids of one kind"):
        rerank(run, queries, docs, lambda query, text: F.length(text).cast("double"))


def test_texts_of_batches_cross_one_exchange(spark):
    pairs = spark.createDataFrame([(f"q{i}", f"d{i}", f"query {i}", f"passage {i}") for i in range(20)] * 3, "qid string, docid string, query_text string, passage_text string")
    batches = training_batches(pairs, 4)
    plan = batches._jdf.queryExecution().executedPlan().toString().splitlines()
    exchanges = [i for i, line in enumerate(plan) if "Exchange" in line and "Broadcast" not in line]
    carried = [i for i in exchanges if "passage_text" in plan[i + 1] and "partial_first" in plan[i + 1]]
    assert len(carried) == 1
    got = batches.collect()
    assert sorted(r["position"] for r in got) == list(range(60)) and len({r["passage_text"] for r in got}) == 20
    again = {r["position"]: r["qid"] for r in training_batches(pairs.repartition(7), 4).collect()}
    assert again == {r["position"]: r["qid"] for r in got}
