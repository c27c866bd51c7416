from __future__ import annotations

from collections import defaultdict
from math import log2

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from rankframe import available_qrels, coverage, evaluate, ndcg_per_query, positives, qrels_map
from rankframe.operators import evaluation

RUN = "qid string, docid string, score double"
QRELS = "qid string, docid string, relevance int"


def brute_ndcg(run, qrels, constant=False):
    """Tie-averaged nDCG over all retrieved depths, by query."""
    rel = {(q, d): r for q, d, r in qrels}
    by_query = defaultdict(list)
    for q, d, s in run:
        by_query[q].append((1.0 if constant else s, rel.get((q, d), 0)))
    out = {}
    for q, docs in by_query.items():
        if sum(r for _, r in docs) == 0:
            continue
        docs.sort(key=lambda x: -x[0])
        dcg = 0.0
        for score in {s for s, _ in docs}:
            tied = [i for i, (s, _) in enumerate(docs) if s == score]
            share = sum(1 / log2(i + 2) for i in tied) / len(tied)
            dcg += share * sum(docs[i][1] for i in tied)
        best = sum(r / log2(i + 2) for i, r in enumerate(sorted((r for _, r in docs), reverse=True)))
        out[q] = pytest.approx(dcg / best)
    return out


def frames(spark, run, qrels):
    return spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QRELS)


def measured(per_query):
    return {r["qid"]: r["ndcg"] for r in per_query.collect()}


ROWS = [
    ("ties", "a", 0.5), ("ties", "b", 0.5), ("ties", "c", 0.9), ("ties", "d", 0.1),
    ("flat", "a", 1.0), ("flat", "b", 1.0), ("flat", "c", 1.0),
    ("one", "a", 0.3),
    ("none", "a", 0.3), ("none", "b", 0.2),
    ("order", "a", 3.0), ("order", "b", 2.0), ("order", "c", 1.0),
]
JUDGED = [
    ("ties", "a", 2), ("ties", "d", 1), ("ties", "zz", 2), ("flat", "b", 1), ("one", "a", 1), ("none", "x", 1),
    ("order", "c", 2), ("order", "a", 1), ("unasked", "a", 1),
]


@pytest.mark.parametrize("depth", [4, None])
@pytest.mark.parametrize("mode", ["score", "constant"])
def test_is_the_published_metric(spark, depth, mode):
    run, qrels = frames(spark, ROWS, JUDGED)
    got = measured(ndcg_per_query(run, qrels, depth=depth, score_mode=mode))
    assert got == brute_ndcg(ROWS, JUDGED, mode == "constant")
    assert "none" not in got and got["one"] == 1.0


def test_mean_leaves_out_queries_without_a_hit(spark):
    run, qrels = frames(spark, ROWS, JUDGED)
    row = evaluate(run, qrels, depth=4).first()
    want = brute_ndcg(ROWS, JUDGED)
    assert row["n_queries"] == 4 and row["ndcg"] == pytest.approx(sum(v.expected for v in want.values()) / 4)
    nothing = evaluate(run, qrels.filter("relevance > 5"), depth=4).first()
    assert tuple(nothing) == (0.0, 0)


def test_textbook_variant(spark):
    run, qrels = frames(spark, ROWS, JUDGED)
    options = {"k": 2, "ideal": "all_judged", "missing_queries": "zero"}
    got = measured(ndcg_per_query(run, qrels, depth=4, **options))
    assert set(got) == {q for q, _, r in JUDGED if r > 0}
    assert got["none"] == got["unasked"] == 0.0
    best = 2 + 2 / log2(3)
    assert got["ties"] == pytest.approx((1 / log2(3) + 0) / 2 * 2 / best)
    assert got["order"] == pytest.approx(1 / (2 + 1 / log2(3)))
    assert measured(ndcg_per_query(run, qrels, **options)) == {q: pytest.approx(v) for q, v in got.items()}
    only = measured(ndcg_per_query(run, qrels, k=2, ideal="all_judged", depth=4))
    assert set(only) == {"ties", "flat", "one", "order"}


def test_options_are_checked(spark):
    run, qrels = frames(spark, ROWS, JUDGED)
    for bad in ({"score_mode": "x"}, {"ideal": "x"}, {"missing_queries": "zero"}):
        with pytest.raises(ValueError):
            ndcg_per_query(run, qrels, **bad)
    with pytest.raises(Exception, match="negative"):
        ndcg_per_query(run, qrels.selectExpr("qid", "docid", "-relevance relevance"), depth=4).collect()


def test_long_spans_of_ranks_are_summed_in_steps(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "RANKS_PER_STEP", 3)
    rows = [("q", f"d{i}", 1.0) for i in range(20)] + [("p", "d1", 1.0)]
    judged = [("q", f"d{i}", 1 + i % 2) for i in range(0, 20, 3)] + [("p", "d1", 3)]
    run, qrels = frames(spark, rows, judged)
    assert measured(ndcg_per_query(run, qrels, score_mode="constant")) == brute_ndcg(rows, judged)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 3), st.integers(0, 2)), min_size=1, max_size=25))
def test_bounds_and_row_order(spark, triples):
    rows = [(q, f"d{i}", float(s)) for i, (q, s, _) in enumerate(triples)]
    judged = [(q, f"d{i}", r) for i, (q, _, r) in enumerate(triples)]
    run, qrels = frames(spark, rows[::-1], judged)
    got = measured(ndcg_per_query(run, qrels, depth=len(rows)))
    assert got == brute_ndcg(rows, judged) and all(0 <= v <= 1 + 1e-12 for v in got.values())


def test_judgment_helpers(spark, rows):
    qrels = spark.createDataFrame([("q", "a", 1), ("q", "a", 2), ("q", "b", 0), ("p", "c", 1)], QRELS)
    assert {r["qid"]: r["judgments"] for r in qrels_map(qrels).collect()} == {"q": {"a": 2, "b": 0}, "p": {"c": 1}}
    many = spark.createDataFrame([("q", f"d{i}", i) for i in range(40)] + [("p", "c", 1)], QRELS)
    split = [r for r in qrels_map(many, max_map=10).collect() if r["qid"] == "q"]
    assert len(split) == split[0]["n_parts"] == 4
    assert {d: r for row in split for d, r in row["judgments"].items()} == {f"d{i}": i for i in range(40)}
    assert positives(qrels).count() == 3
    stored = spark.createDataFrame([("a", [1.0]), ("zz", [1.0])], "docid string, embedding array<float>")
    assert rows(available_qrels(qrels, stored)) == [("q", "a", 1), ("q", "a", 2)]


def test_coverage(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("x",)], "docid string")
    run = spark.createDataFrame([("q", "a"), ("q", "x"), ("p", "a"), ("p", "gone")], "qid string, docid string")
    qrels = spark.createDataFrame([("q", "a", 1), ("p", "a", 0), ("q", "c", 1)], QRELS)
    assert coverage(docs, qrels, run).first().asDict() == {
        "judged_docs": 2, "judged_docs_found": 1, "qrels_kept": 2, "pairs_prepared": 3, "pairs_missing": 1,
    }
