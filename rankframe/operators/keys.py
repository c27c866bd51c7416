"""Identity and membership: one row per id, documents that are judged, judgments that are usable."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.ranking import written
from rankframe.functions.sizing import broadcast_if_small


def dedupe_by_id(
    df: DataFrame, key: str | Sequence[str] = "docid", order: Sequence[str] = (), keep: str = "last"
) -> DataFrame:
    """One row per key: the last (or first) by ``order``, then by the remaining columns.

    A max (min) over a struct is combined before the shuffle, so a key with very many copies sends one
    row per task.
    """
    if keep not in ("last", "first"):
        raise ValueError("keep must be 'last' or 'first'")
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in df.columns if c not in keys]
    ordered = [*order, *[c for c in others if c not in order]]
    if not ordered:
        return df.dropDuplicates(keys)
    pick = F.max if keep == "last" else F.min
    picked = df.groupBy(*keys).agg(pick(F.struct(*ordered)).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def positives(qrels: DataFrame) -> DataFrame:
    return qrels.filter(F.col("relevance") > 0)


def unique_judgments(qrels: DataFrame, by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """One relevance per (query, document): the last by the columns ``order`` (a file, a row number), and the highest
    where they leave several. Files keep no row order, so without ``order`` the highest counts."""
    last = F.max(F.struct(*order, "relevance"))["relevance"] if order else F.max("relevance")
    return qrels.groupBy(*by, "qid", "docid").agg(last.alias("relevance"))


def with_ids_of(docs: DataFrame, ids: DataFrame, rows: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Documents named in ``ids``. A list of checked size is broadcast, so the corpus is filtered where it
    is read; ``rows`` is a proven bound on the list, which spares measuring it."""
    keys = [*by, "docid"]
    ids = ids.select(*keys).distinct()
    return docs.join(broadcast_if_small(ids, rows=rows), keys, "left_semi").select(*docs.columns)


def judged_corpus(docs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Documents with at least one judgment."""
    return with_ids_of(docs, qrels)


def available_qrels(qrels: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Judgments whose document has a stored vector.

    The judgments are the small side here, so the vector ids are first cut down to judged ones: only
    those few cross the network.
    """
    stored = with_ids_of(embeddings.select("docid"), qrels)
    return qrels.join(stored.distinct(), "docid", "left_semi").select(*qrels.columns)


def split_heavy(df: DataFrame, key: str, counts: DataFrame, limit: int, member: str = "docid") -> DataFrame:
    """``df`` with ``part`` and ``n_parts``: one part per key, or several, by a hash of ``member``, for keys
    with more than ``limit`` rows by ``counts(key, n)``.

    The heavy keys are stored and, being few, broadcast, so that ``df`` is not shuffled by a heavy key.
    """
    parts = F.ceil(F.col("n") / F.lit(limit)).cast("int").alias("n_parts")
    heavy = broadcast_if_small(written(counts.filter(F.col("n") > limit).select(key, parts)))
    number = F.conv(F.substring(F.md5(F.col(member).cast("string")), 1, 8), 16, 10).cast("long")
    n_parts = F.coalesce("n_parts", F.lit(1))
    alone = (n_parts == 1) & F.col(member).isNotNull()
    part = F.when(alone, F.lit(0)).otherwise(F.pmod(number, n_parts).cast("int"))
    return df.join(heavy, key, "left").select(*df.columns, part.alias("part"), n_parts.alias("n_parts"))
