"""nDCG of a run against judgments, and the counts that go with it.

The metric follows the published tie-averaged definition: linear gain, discount 1/log2(rank + 1), and
documents of one score share their mean discount. By default it is taken over the whole retrieved depth,
the ideal order is that of the retrieved documents, and a query that retrieved nothing relevant is left
out of the mean. The textbook choices are options with their own names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import with_rank, written
from rankframe.functions.scoring import discount
from rankframe.operators.keys import split_heavy, unique_judgments, with_ids_of

RANKS_PER_STEP = 4096


def judged_run(run: DataFrame, qrels: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """The run with a relevance per row, 0 where nobody judged it."""
    judged = run.join(unique_judgments(qrels, by, order), [*by, "qid", "docid"], "left")
    relevance = F.coalesce("relevance", F.lit(0))
    refused = F.raise_error(F.lit("relevance must not be negative")).cast("int")
    return judged.withColumn("relevance", F.when(relevance < 0, refused).otherwise(relevance))


def _ranked_gain(ranked: DataFrame, k: int | None, query: list[str]) -> DataFrame:
    """Discounted gain per query of rows with a rank. Rows of one score share their mean discount, both
    parts of which are combined before any shuffle. With an ``ideal`` rank also the ideal gain."""

    def within(rank: str) -> Column:
        value = discount(F.col(rank))
        return value if k is None else F.when(F.col(rank) <= k, value).otherwise(F.lit(0.0))

    best = F.sum(F.col("relevance") * within("ideal")) if "ideal" in ranked.columns else F.lit(None)
    groups = ranked.groupBy(*query, "score").agg(
        F.avg(within("rank")).alias("discount"), F.sum("relevance").alias("gain"), best.alias("best")
    )
    gains = groups.groupBy(*query).agg(
        F.sum(F.col("gain") * F.col("discount")).alias("dcg"), F.sum("best").alias("idcg")
    )
    return gains if "ideal" in ranked.columns else gains.drop("idcg")


def _level_gain(rows: DataFrame, level: str, k: int | None, query: list[str]) -> DataFrame:
    """The same where few levels order the rows (relevance grades, one constant score): rows of a level are
    counted before the shuffle, and the ranks they span follow from the counts."""
    levels = rows.groupBy(*query, level).agg(F.count(F.lit(1)).alias("n"), F.sum("relevance").alias("gain"))
    above = Window.partitionBy(*query).orderBy(F.desc(level)).rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n").over(above), F.lit(0)) + 1
    spans = levels.withColumn("first", first).withColumn("last", F.col("first") + F.col("n") - 1)
    if k is not None:
        spans = spans.withColumn("last", F.least("last", F.lit(k))).filter(F.col("first") <= k)
    step = F.lit(RANKS_PER_STEP).cast("long")
    pieces = spans.withColumn("from", F.explode(F.sequence("first", "last", step)))
    ranks = F.sequence("from", F.least(F.col("from") + step - 1, F.col("last")))
    summed = F.aggregate(ranks, F.lit(0.0), lambda total, rank: total + discount(rank))
    return pieces.groupBy(*query).agg(F.sum(F.col("gain") / F.col("n") * summed).alias("dcg"))


def ndcg_per_query(
    run: DataFrame,
    qrels: DataFrame,
    *,
    score: str = "score",
    score_mode: str = "score",
    k: int | None = None,
    ideal: str = "retrieved",
    missing_queries: str = "exclude",
    depth: int | None = None,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
) -> DataFrame:
    """``(…by, qid, dcg, idcg, ndcg)`` for the queries that count. Columns in ``by`` (a snapshot) are part of a
    query's key in run and judgments; ``order`` says which of repeated judgments is the last, and so the one that counts.

    ``score_mode="constant"`` treats all documents as tied, which makes the order irrelevant.
    ``k`` cuts both orders. ``ideal="all_judged"`` takes the ideal order from all judgments.
    ``missing_queries="zero"`` counts judged queries without a relevant hit as 0. ``depth`` is a proven
    bound on the rows per query in the run.
    """
    for value, allowed in (
        (score_mode, ("score", "constant")),
        (ideal, ("retrieved", "all_judged")),
        (missing_queries, ("exclude", "zero")),
    ):
        if value not in allowed:
            raise ValueError(f"{value!r} is not one of {allowed}")
    if missing_queries == "zero" and ideal != "all_judged":
        raise ValueError("counting missing queries needs ideal='all_judged'")
    constant = score_mode == "constant"
    value = F.lit(1.0) if constant else F.col(score)
    query = [*by, "qid"]
    judged = judged_run(run.select(*query, "docid", value.alias("score")), qrels, by, order)
    if not constant and ideal == "retrieved" and depth is not None:
        both = with_rank(with_rank(judged, by=query, depth=depth), "relevance", by=query, depth=depth, name="ideal")
        gains = _ranked_gain(both, k, query).filter(F.col("idcg") > 0)
        return gains.select(*query, "dcg", "idcg", (F.col("dcg") / F.col("idcg")).alias("ndcg"))

    if constant:
        judged = written(judged)
        dcg = _level_gain(judged, "score", k, query)
    else:
        judged = judged if depth is not None else written(judged)
        dcg = _ranked_gain(with_rank(judged, by=query, depth=depth), k, query)
    pool = judged if ideal == "retrieved" else unique_judgments(qrels, by, order)
    relevant = pool.filter(F.col("relevance") > 0)
    idcg = _level_gain(relevant, "relevance", k, query).withColumnRenamed("dcg", "idcg")
    both = dcg.join(idcg, query, "right" if missing_queries == "zero" else "inner")
    if missing_queries == "exclude" and ideal == "all_judged":
        hits = judged.filter(F.col("relevance") > 0).select(*query).distinct()
        both = both.join(hits, query, "left_semi")
    gained = F.coalesce("dcg", F.lit(0.0))
    return both.select(*query, gained.alias("dcg"), "idcg", (gained / F.col("idcg")).alias("ndcg"))


def mean_metric(per_query: DataFrame, metric: str = "ndcg", by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each value of ``by``: the mean over the counted queries, 0.0 when there are none."""
    return (per_query.groupBy(*by) if by else per_query).agg(
        F.coalesce(F.avg(metric), F.lit(0.0)).alias(metric), F.count(F.lit(1)).alias("n_queries")
    )


def evaluate(run: DataFrame, qrels: DataFrame, **options) -> DataFrame:
    return mean_metric(ndcg_per_query(run, qrels, **options), by=options.get("by", ()))


def qrels_map(qrels: DataFrame, max_map: int = 100_000, order: Sequence[str] = ()) -> DataFrame:
    """Judgments as one map per query, ``(qid, part, n_parts, judgments)``; a query with more than
    ``max_map`` judgments has several."""
    pairs = unique_judgments(qrels, order=order)
    counts = qrels.groupBy("qid").agg(F.count(F.lit(1)).alias("n"))
    parted = split_heavy(pairs, "qid", counts, max_map)
    entries = F.collect_list(F.struct("docid", "relevance"))
    return parted.groupBy("qid", "part").agg(
        F.max("n_parts").alias("n_parts"), F.map_from_entries(entries).alias("judgments")
    )


def coverage(docs: DataFrame, qrels: DataFrame, run: DataFrame) -> DataFrame:
    """One row of counts: judged documents, how many of them the corpus has, judgments that are usable
    with it, and pairs of the run with and without a document."""
    judged = qrels.select("docid", F.lit(1).alias("judged"), F.lit(0).alias("listed"))
    listed = run.select("docid", F.lit(0).alias("judged"), F.lit(1).alias("listed"))
    named = judged.unionByName(listed).groupBy("docid")
    named = written(named.agg(F.sum("judged").alias("judged"), F.sum("listed").alias("listed")))
    known = with_ids_of(docs.select("docid"), named).distinct().withColumn("known", F.lit(True))
    is_judged, is_known = F.col("judged") > 0, F.col("known").isNotNull()

    def total(column: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(column))), F.lit(0))

    return named.join(known, "docid", "left").agg(
        F.count_if(is_judged).alias("judged_docs"),
        F.count_if(is_judged & is_known).alias("judged_docs_found"),
        total("judged", is_known).alias("qrels_kept"),
        total("listed", is_known).alias("pairs_prepared"),
        total("listed", ~is_known).alias("pairs_missing"),
    )
