from __future__ import annotations

from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankframe import rrf, top_k, weighted_fusion, with_rank

SCHEMA = "qid string, docid string, score double, rank int"
A = [("q1", "a", 0.9, 1), ("q1", "b", 0.5, 2), ("q2", "c", 0.4, 1)]
B = [("q1", "b", 0.8, 1), ("q1", "d", 0.1, 2)]
C = [("q1", "d", 12.0, 1), ("q1", "a", 3.0, 2), ("q2", "e", 1.0, 1)]


@pytest.fixture(scope="module")
def runs(spark):
    return [spark.createDataFrame(r, SCHEMA) for r in (A, B, C)]


def ordered(run):
    return [tuple(r) for r in run.orderBy("qid", "rank").collect()]


def brute_fusion(runs, weights):
    scores = defaultdict(float)
    for run, w in zip(runs, weights):
        for qid, docid, score, _ in run:
            scores[qid, docid] += w * score
    return ranks(scores)


def ranks(scores):
    out = []
    for qid in sorted({q for q, _ in scores}):
        mine = sorted(((-round(s, 9), d, s) for (q, d), s in scores.items() if q == qid))
        out += [(qid, d, pytest.approx(s), i + 1) for i, (_, d, s) in enumerate(mine)]
    return out


@pytest.mark.parametrize("depth", [2, None])
def test_weighted(runs, depth):
    want = brute_fusion((A, B, C), (0.8, 0.1, 0.1))
    assert ordered(weighted_fusion(runs, (0.8, 0.1, 0.1), depth=depth)) == want
    assert ordered(weighted_fusion(runs, (0.8, 0.1, 0.1), unique=False)) == want


def test_first_expert_alone_keeps_its_order(runs):
    fused = weighted_fusion(runs, (1, 0, 0), depth=2).filter(F.col("fused_score") > 0)
    assert [r[:2] for r in ordered(fused)] == [r[:2] for r in A]


def test_repeated_rows_multiply(spark, runs):
    double = runs[1].unionByName(runs[1])
    fused = weighted_fusion([runs[0], double, runs[2]], unique=False)
    assert fused.filter("qid = 'q1' and docid = 'b'").count() == 2


def test_one_weight_per_run(runs):
    with pytest.raises(ValueError):
        weighted_fusion(runs, (0.5, 0.5))


@pytest.mark.parametrize("depth", [2, None])
def test_rrf(runs, depth):
    scores = defaultdict(float)
    for run in (A, B, C):
        for qid, docid, _, rank in run:
            scores[qid, docid] += 1 / (60 + rank)
    assert ordered(rrf(runs, depth=depth)) == ranks(scores)
    assert ordered(rrf(runs[::-1], depth=depth)) == ranks(scores)
    assert ordered(rrf([run.drop("rank") for run in runs], depth=depth)) == ranks(scores)


def test_rank_from_zero(runs):
    assert [r[-1] for r in ordered(with_rank(runs[0].drop("rank"), base=0, depth=2))] == [0, 1, 0]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("aaaab"), st.integers(0, 4)), min_size=1, max_size=60))
def test_a_heavy_query_is_ranked_in_parts(spark, pairs):
    rows = [(q, f"d{i:03}", float(s)) for i, (q, s) in enumerate(pairs)]
    frame = spark.createDataFrame(rows, "qid string, docid string, score double")
    assert ordered(with_rank(frame)) == ordered(with_rank(frame, depth=len(rows)))


def test_top_k_in_rounds(spark, monkeypatch):
    import rankframe.functions.ranking as ranking

    frame = spark.range(500).select(
        F.lit("q").alias("qid"), F.col("id").alias("docid"), (F.col("id") % 17).cast("double").alias("score")
    )
    plain = ordered(top_k(frame, 40))
    monkeypatch.setattr(ranking, "FAN_IN", 2)
    assert ordered(top_k(frame, 40)) == plain
