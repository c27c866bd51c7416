"""Fusion, reciprocal rank fusion, reranking and evaluation; runs and the reranked run are stored on the way."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame

from rankframe.functions.ranking import written
from rankframe.operators.evaluation import ndcg_per_query
from rankframe.operators.fusion import rrf, weighted_fusion
from rankframe.operators.rerank import Scorer, rerank


class Hybrid(NamedTuple):
    fused: DataFrame
    rrf: DataFrame
    reranked: DataFrame
    ndcg: DataFrame


def hybrid_pipeline(
    runs: Sequence[DataFrame],
    queries: DataFrame,
    docs: DataFrame,
    qrels: DataFrame,
    scorer: Scorer,
    weights: Sequence[float] = (0.8, 0.1, 0.1),
    *,
    depth: int | None = None,
) -> Hybrid:
    """``fused`` stands by itself; ``rrf`` is what gets reranked, and ``ndcg`` judges the reranked run per
    query. The runs are stored once, as both fusions read them, and so is
    the reranked run, so that the model scores a pair once. ``depth`` is their k, where known; it
    bounds every later step."""
    runs = [written(run) for run in runs]
    together = None if depth is None else depth * len(runs)
    by_rank = rrf(runs, depth=depth)
    reranked = written(rerank(by_rank, queries, docs, scorer, depth=together))
    return Hybrid(
        weighted_fusion(runs, weights, depth=depth),
        by_rank,
        reranked,
        ndcg_per_query(reranked, qrels, depth=together),
    )
