"""Every registered query against its SQL, and the plans that matter at scale."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from checks import spark as checked
from checks.compare import differences, tables_in

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables_in(SF)


@pytest.mark.parametrize("name", list(checked.QUERIES))
def test_same_as_sql(spark, con, name):
    n, wrong = differences(spark, con, SF, name)
    assert not wrong and n > 0


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["qid", "docid", "score", "rank"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_bm25_cuts_before_the_shuffle_by_query(spark):
    text = plan(checked.bm25_topk(spark, SF))
    assert text.count("WindowGroupLimit") == 2
    assert "BroadcastHashJoin [term" in text and "CartesianProduct" not in text and "NestedLoop" not in text
    shuffles = [line for line in text.splitlines() if "Exchange hashpartitioning(qid" in line and "docid" in line]
    assert not shuffles, "scores must be summed where the documents lie"


@pytest.mark.parametrize("name", sorted(set(checked.QUERIES) - {"dense_topk", "dense_topk_blocked", "dense_topk_deep", "dense_pruned"}))
def test_no_cross_join(spark, name):
    text = plan(checked.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text


@pytest.mark.parametrize("name", ["bm25_topk", "search_top10", "postings", "ndcg_per_query"])
def test_lexical_queries_stay_in_the_jvm(spark, name):
    if name not in checked.QUERIES:
        pytest.skip("not registered")
    text = plan(checked.QUERIES[name](spark, SF))
    assert "Python" not in text and "MapInArrow" not in text
