"""Putting texts to a run's ids and ordering the run anew by a pair score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.functions.ranking import shuffle_partitions, with_rank, written
from rankframe.functions.scoring import PairScorer
from rankframe.functions.sizing import broadcast_if_small
from rankframe.operators.encoding import scores_or_compute
from rankframe.operators.keys import with_ids_of

Scorer = Callable[[Column, Column], Column]
Form = Callable[[Column], Column]


def as_given(text: Column) -> Column:
    return text


def steps(scorer: Scorer) -> tuple[Form, Scorer]:
    """What a scorer makes once of each query and each text, and its score of what it made."""
    return (scorer.prepare, scorer.score) if isinstance(scorer, PairScorer) else (as_given, scorer)


def hydrate(
    run: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    missing: str = "drop",
    by: Sequence[str] = (),
    query_form: Form = as_given,
    text_form: Form = as_given,
) -> DataFrame:
    """``(qid, docid, query, text)`` for each row of the run, spread evenly over the cluster, queries and texts in the
    given forms, which are made before they meet the run: once for each, not once for each pair.

    ``docs`` is ``(docid, text)``. A document without text is dropped, or kept with the empty text under
    ``missing="blank"``. The run is stored first, for it is needed twice: its ids cut the corpus down
    before any of it is shuffled, and its pairs then meet the texts that are left.
    """
    if missing not in ("drop", "blank"):
        raise ValueError("missing must be 'drop' or 'blank'")
    by = list(by)
    pairs = written(run.select(*by, "qid", "docid"))
    needed = with_ids_of(docs.select(*by, "docid", "text"), pairs, by=by)
    asked = queries.select(*by, "qid", query_form(F.col("query")).alias("query"))
    unknown = missing == "drop" and needed.select("docid").isEmpty()
    if (unknown or pairs.join(asked, [*by, "qid"], "left_semi").isEmpty()) and not pairs.isEmpty():
        raise ValueError("no pair of the run has a query and a text; are the ids of one kind?")
    formed = needed.select(*by, "docid", text_form(F.coalesce("text", F.lit(""))).alias("text"))
    texts = pairs.join(formed, [*by, "docid"], "inner" if missing == "drop" else "left")
    hydrated = texts.join(broadcast_if_small(asked), [*by, "qid"])
    text = F.coalesce("text", text_form(F.lit("")))
    return for_scoring(hydrated.select(*by, "qid", "docid", "query", text.alias("text")), *by)


def for_scoring(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs in as many partitions as a shuffle has. Few bytes can be long work for a model, and partitions
    chosen by bytes would leave it to one task."""
    return pairs.repartition(shuffle_partitions(pairs), *by, "qid", "docid")


def rerank(
    run: DataFrame,
    queries: DataFrame,
    docs: DataFrame,
    scorer: Scorer,
    missing: str = "drop",
    *,
    query_format: Form | None = None,
    depth: int | None = None,
    by: Sequence[str] = (),
    store: str | None = None,
) -> DataFrame:
    """Score every candidate of the run again and rank by that score. Nothing is cut off.

    ``scorer`` makes a column of (query, text): an expression, a model hook, or a ``PairScorer``, whose first step is done
    once for each query and each document of the run. ``depth`` is a proven bound on the run's rows per query. Scores
    order the run as they are, however close. Columns in ``by`` (a snapshot) are part of the key of run, queries and
    docs. A run of which no document, or no query, is known is an error, unless the run itself is empty. With ``store``,
    a folder, scores of text pairs are kept there and found again.
    """
    by, (form, score) = list(by), steps(scorer)
    shaped = as_given if query_format is None else query_format
    if store is not None:
        plain = hydrate(run, queries, docs, missing, by, query_form=shaped)
        return with_rank(scores_or_compute(plain, store, scorer), by=[*by, "qid"], depth=depth)
    pairs = hydrate(run, queries, docs, missing, by, query_form=lambda query: form(shaped(query)), text_form=form)
    scored = pairs.select(*by, "qid", "docid", score(F.col("query"), F.col("text")).alias("score"))
    return with_rank(scored, by=[*by, "qid"], depth=depth)
