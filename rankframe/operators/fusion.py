"""Combining the runs of several experts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.ranking import with_rank
from rankframe.functions.scoring import rrf_term, weighted_sum

FUSED_DIGITS = 10
"""Weights carry a few decimals of their own, so a weighted sum of rounded scores needs more than they have."""
RRF_DIGITS = 12
"""Deep neighbouring ranks differ by about 1/(k+rank)², far below the digits kept for other scores."""


def _depth(runs: Sequence[DataFrame], depth: int | None) -> int | None:
    return None if depth is None else depth * len(runs)


def _stacked(runs: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """All runs below each other, partitioned by (query, document). Left to itself the union keeps the
    runs' partitioning by query, under which a heavy query is one task's work."""
    return reduce(DataFrame.unionByName, runs).repartition(*by, "qid", "docid")


def _scores_side_by_side(runs: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """One row per (query, document) with a score column per expert, in one shuffle."""
    experts = [run.select(*by, "qid", "docid", "score", F.lit(i).alias("expert")) for i, run in enumerate(runs)]
    of_expert = [F.sum(F.when(F.col("expert") == i, F.col("score"))).alias(f"score_{i}") for i in range(len(runs))]
    return _stacked(experts, by).groupBy(*by, "qid", "docid").agg(*of_expert)


def _scores_joined(runs: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """The same as a chain of full outer joins, where repeated (query, document) rows multiply."""
    named = [run.select(*by, "qid", "docid", F.col("score").alias(f"score_{i}")) for i, run in enumerate(runs)]
    return reduce(lambda left, right: left.join(right, [*by, "qid", "docid"], "full_outer"), named)


def weighted_fusion(
    runs: Sequence[DataFrame],
    weights: Sequence[float] = (0.4, 0.4, 0.2),
    *,
    depth: int | None = None,
    unique: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """Weighted sum of the experts' raw scores, 0.0 where an expert did not return a document.

    Nothing is cut off. ``depth`` is the k of the runs, where known. ``unique=False`` is for runs that
    may hold a (query, document) more than once. Columns in ``by`` (a snapshot) are part of the key.
    """
    if len(runs) != len(weights):
        raise ValueError("one weight per run")
    wide = (_scores_side_by_side if unique else _scores_joined)(runs, by)
    filled = [F.coalesce(F.col(f"score_{i}"), F.lit(0.0)) for i in range(len(runs))]
    fused = wide.select(*by, "qid", "docid", F.round(weighted_sum(filled, weights), FUSED_DIGITS).alias("fused_score"))
    return with_rank(fused, "fused_score", by=[*by, "qid"], depth=_depth(runs, depth) if unique else None)


def rrf(runs: Sequence[DataFrame], k: int = 60, *, depth: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Reciprocal rank fusion. A run without a rank column is ranked by its score first. Columns in ``by`` are part of
    the key."""
    ranked = [run if "rank" in run.columns else with_rank(run, by=[*by, "qid"], depth=depth) for run in runs]
    terms = [run.select(*by, "qid", "docid", rrf_term(F.col("rank"), k).alias("term")) for run in ranked]
    fused = _stacked(terms, by).groupBy(*by, "qid", "docid").agg(F.round(F.sum("term"), RRF_DIGITS).alias("rrf_score"))
    return with_rank(fused, "rrf_score", by=[*by, "qid"], depth=_depth(runs, depth))
