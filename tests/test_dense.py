from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankframe import by_pivot, cosine, dense_search, top_k
from rankframe.functions import ranking
from rankframe.operators import dense
from rankframe.operators.encoding import model_encoder

RNG = np.random.default_rng(5)


def vectors(spark, matrix, ids, name="docid", kind="string"):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, matrix)]
    return spark.createDataFrame(rows, f"{name} {kind}, embedding array<float>")


def brute(q, qids, d, ids, k, descending=False):
    q, d = np.float32(q).astype(float), np.float32(d).astype(float)
    out = []
    for i, qid in enumerate(qids):
        size = np.linalg.norm(q[i]) * np.linalg.norm(d, axis=1)
        sims = np.round(np.divide(d @ q[i], size, out=np.zeros(len(d)), where=size > 0), 6)
        order = sorted(sorted(range(len(ids)), key=lambda j: ids[j], reverse=descending), key=lambda j: -sims[j])
        out += [(qid, ids[j], pytest.approx(sims[j], abs=2e-6), r + 1) for r, j in enumerate(order[:k])]
    return out


def ordered(run):
    return [tuple(r) for r in run.orderBy("qid", "rank").collect()]


@pytest.fixture(scope="module")
def data():
    docs = RNG.normal(size=(300, 8))
    docs[100:200] = docs[100]
    docs[7] = 0
    queries = np.vstack([RNG.normal(size=(6, 8)), docs[100]])
    return queries, [f"q{i}" for i in range(7)], docs, [f"d{(i * 37) % 300:03}" for i in range(300)]


@pytest.mark.parametrize("k,block", [(10, 16_384), (10, 32), (150, 7), (400, 50)])
def test_is_brute_force_with_ties(spark, data, k, block):
    q, qids, d, ids = data
    run = dense_search(vectors(spark, q, qids, "qid"), vectors(spark, d, ids).repartition(5), k, block=block)
    assert ordered(run) == brute(q, qids, d, ids, k)


def test_many_queries_meet_documents_in_a_grid(spark, data, monkeypatch):
    monkeypatch.setattr(dense, "CELL_BYTES", 4000)
    q, qids, d, ids = data
    asked, stored = vectors(spark, q, qids, "qid"), vectors(spark, d, ids)
    assert ordered(dense_search(asked, stored, 20, query_bytes=1500)) == brute(q, qids, d, ids, 20)


def test_later_position_first(spark, data):
    q, qids, d, _ = data
    ids = list(range(300))
    stored = vectors(spark, d, ids, kind="int").withColumn("position", F.col("docid"))
    run = dense_search(vectors(spark, q, qids, "qid"), stored, 30, tie="position", tie_desc=True, block=64)
    assert ordered(run) == brute(q, qids, d, ids, 30, descending=True)


def test_groups_do_not_mix(spark, data):
    q, qids, d, ids = data
    part = F.when(F.col("docid") < "d150", "a").otherwise("b")
    stored = vectors(spark, d, ids).withColumn("snapshot", part)
    asked = vectors(spark, q, qids, "qid").withColumn("snapshot", F.when(F.col("qid") < "q3", "a").otherwise("c"))
    run = dense_search(asked, stored, 5, by=["snapshot"])
    low = [i for i in range(300) if ids[i] < "d150"]
    assert [r[1:] for r in sorted(map(tuple, run.collect()), key=lambda r: (r[1], r[4]))] == brute(
        q[:3], qids[:3], d[low], [ids[i] for i in low], 5
    )


def test_cosine_column_agrees(spark, data):
    q, qids, d, ids = data
    pairs = vectors(spark, d, ids).withColumn("q", F.array(*[F.lit(float(np.float32(x))) for x in q[0]]))
    got = {r["docid"]: r["s"] for r in pairs.select("docid", cosine(F.col("q"), F.col("embedding")).alias("s")).collect()}
    want = {r[1]: r[2] for r in brute(q[:1], qids[:1], d, ids, 300)}
    assert got == want and got[ids[7]] == 0.0


def test_no_documents_or_queries(spark, data):
    q, qids, d, ids = data
    asked, stored = vectors(spark, q, qids, "qid"), vectors(spark, d, ids)
    assert dense_search(asked, stored.filter(F.lit(False)), 5).collect() == []
    assert dense_search(asked.filter(F.lit(False)), stored, 5).collect() == []


def test_lengths_must_agree(spark):
    stored = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "docid string, embedding array<float>")
    asked = spark.createDataFrame([("q", [1.0, 2.0])], "qid string, embedding array<float>")
    with pytest.raises(Exception, match="differ in length"):
        dense_search(asked, stored.coalesce(1), 5).collect()


def load_letters():
    def predict(texts):
        return np.array([[text.count(c) for c in "aeiou"] for text in texts], dtype=np.float32)

    return predict


def test_encoder_and_format(spark):
    stored = spark.createDataFrame([("a", [2.0, 0.0, 0.0, 0.0, 0.0]), ("o", [0.0, 0.0, 0.0, 1.0, 0.0])], "docid string, embedding array<float>")
    asked = spark.createDataFrame([("1", "AAA"), ("2", " ooa")], "qid string, query string")
    run = dense_search(asked, stored, 1, encoder=model_encoder(load_letters), fmt=lambda c: F.lower(c))
    assert [(r["qid"], r["docid"]) for r in run.orderBy("qid").collect()] == [("1", "a"), ("2", "o")]


def test_close_angles_keep_their_order(spark):
    angles = {"a": 8e-4, "b": 4e-4, "c": 1e-4}
    stored = [(name, [float(np.cos(x)), float(np.sin(x))]) for name, x in angles.items()]
    docs = spark.createDataFrame(stored, "docid string, embedding array<double>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")
    assert [r["docid"] for r in dense_search(query, docs, 3).orderBy("rank").collect()] == ["c", "b", "a"]


def test_vectors_with_nan_are_refused(spark):
    docs = spark.createDataFrame([("a", [float("nan"), 1.0])], "docid string, embedding array<double>")
    query = spark.createDataFrame([("q", [1.0, 0.0])], "qid string, embedding array<double>")
    with pytest.raises(Exception, match="no finite number"):
        dense_search(query, docs, 3).collect()


@pytest.mark.parametrize("tasks,k", [(1000, 1500), (1000, 3), (70_000, 5), (9, 7)])
def test_top_k_merges_in_rounds(spark, monkeypatch, tasks, k):
    """Lists of many tasks; every shuffle is below a cut, also beyond Spark's own limit."""
    n = 40 if tasks > 1000 else tasks
    if tasks > 1000:
        monkeypatch.setattr(ranking, "FAN_IN", 3)
        tasks = n
    rows = spark.range(0, n * 20, 1, n).select(
        (F.col("id") % 2).alias("qid"), F.col("id").alias("docid"), (F.col("id") * 7919 % 1000).cast("double").alias("score")
    )
    run = top_k(rows, k, tasks=tasks)
    plan = run._jdf.queryExecution().executedPlan().toString()
    rounds = 1
    while ranking.FAN_IN**rounds < tasks:
        rounds += 1
    assert plan.count("row_number(), ") == 2 * rounds and plan.count("Exchange hashpartitioning") == rounds
    want = sorted(((i % 2, -(i * 7919 % 1000), i) for i in range(n * 20)))
    want = [(q, d, float(-s), r + 1) for q in (0, 1) for r, (_, s, d) in enumerate([w for w in want if w[0] == q][:k])]
    assert sorted((r["qid"], r["docid"], r["score"], r["rank"]) for r in run.collect()) == sorted(want)


@pytest.mark.parametrize("k,step", [(5, 16), (40, 7), (300, 64)])
def test_search_over_pivots_is_exact(spark, monkeypatch, data, k, step):
    monkeypatch.setattr(dense, "STEP", step)
    q, qids, d, ids = data
    stored = by_pivot(vectors(spark, d, ids), pivots=12)
    assert sorted(r["docid"] for r in stored.collect()) == sorted(ids) and stored.columns == ["docid", "embedding"]
    assert ordered(dense_search(vectors(spark, q, qids, "qid"), stored, k)) == brute(q, qids, d, ids, k)


def test_bounds_spare_most_products_of_clustered_vectors():
    centres = RNG.normal(size=(50, 12))
    docs = np.concatenate([c + RNG.normal(size=(200, 12)) * 0.05 for c in centres])
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    queries = centres[:20] / np.linalg.norm(centres[:20], axis=1, keepdims=True)
    best = dense._Best(20, 10, False)
    spared = 0
    for at in range(0, len(docs), 200):
        rows = np.arange(at, at + 200)
        spared += best.add(queries, docs[rows], rows, rows)
    assert spared > 0.6 * 20 * 50
    order = np.argsort(-np.rint(queries @ docs.T * dense.SCALE), axis=1, kind="stable")[:, :10]
    assert [best.docid[best.query == i].tolist() for i in range(20)] == order.tolist()


def test_bounds_of_runs_with_empty_and_opposite_vectors():
    queries = np.array([[1.0, 0.0], [0.0, 1.0]])
    assert (dense._bounds(queries, np.array([[1.0, 0.0], [-1.0, 0.0]])) == 1).all()
    assert (dense._bounds(queries, np.array([[0.0, -1.0], [0.0, 0.0]])) >= 0).all()
