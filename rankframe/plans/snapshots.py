"""Dense retrieval and reranking for dated slices of a corpus, restartable by slice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions.ranking import with_rank, written
from rankframe.functions.sizing import broadcast_if_small
from rankframe.functions.text import PASSAGE_PREFIX, assemble_text, is_blank, normalize_query, strip_prefix
from rankframe.operators.dense import dense_search
from rankframe.operators.encoding import embeddings_or_compute
from rankframe.operators.keys import dedupe_by_id
from rankframe.operators.rerank import Scorer, for_scoring, rerank, steps
from rankframe.sources.readers import CORPUS_FILES, read_snapshots, snapshot_names
from rankframe.sources.writers import in_run_order, to_trec_lines

RUN_TAG = "e5-reranked"


def snapshot_runs(
    docs: DataFrame, queries: DataFrame, embeddings: DataFrame, scorer: Scorer, k: int = 100
) -> DataFrame:
    """``(snapshot, qid, docid, score, rank)`` for all snapshots in one job.

    ``docs`` has title and abstract, ``queries`` query and embedding, ``embeddings`` embedding, each with
    its ``snapshot``. The pair is scored with the lowercased query and the unstripped text, empty where
    the document is gone.
    """
    near = written(dense_search(queries, embeddings, k, by=["snapshot"]).select("snapshot", "qid", "docid"))
    keys = near.select("snapshot", "docid").distinct()
    needed = docs.join(broadcast_if_small(keys), ["snapshot", "docid"], "left_semi")
    form, score = steps(scorer)
    texts = needed.select("snapshot", "docid", form(assemble_text()).alias("text"))
    asked = queries.select("snapshot", "qid", form(strip_prefix(normalize_query("query"))).alias("query"))
    hydrated = near.join(texts, ["snapshot", "docid"], "left").join(
        broadcast_if_small(asked), ["snapshot", "qid"]
    )
    pair = score(F.col("query"), F.coalesce("text", form(F.lit(""))))
    scored = for_scoring(hydrated, "snapshot").select("snapshot", "qid", "docid", pair.alias("score"))
    return with_rank(scored, by=["snapshot", "qid"], depth=k)


def rerank_from_embeddings(
    queries: DataFrame,
    embeddings: DataFrame,
    docs: DataFrame,
    scorer: Scorer,
    k: int = 100,
    *,
    encoder: Callable[[Column], Column] | None = None,
    position: str | None = None,
) -> DataFrame:
    """Stored vectors to a reranked run. Of documents with one similarity the later by ``position`` comes
    first. The scorer sees the raw query, and the empty text where a document has none."""
    order = {"tie": position, "tie_desc": True} if position else {}
    near = dense_search(queries, embeddings, k, encoder=encoder, **order)
    return rerank(near, queries, docs, scorer, "blank", depth=k)


def finished_snapshots(spark: SparkSession, out: str) -> list[str]:
    """Names of the snapshot folders that ``out`` already holds a run for."""
    return snapshot_names(spark, out)


def run_snapshots(
    spark: SparkSession,
    root: str,
    out: str,
    encoder: Callable[[Column], Column],
    scorer: Scorer,
    k: int = 100,
    *,
    vectors: str | None = None,
    skip_existing: bool = True,
    tag: str = RUN_TAG,
    files: str = CORPUS_FILES,
) -> None:
    """Read the snapshots under ``root``, encode what ``vectors`` lacks, search, rerank, and write gzipped
    run files under ``out/snapshot=…``. Snapshots already there are left alone with ``skip_existing``."""
    done = finished_snapshots(spark, out) if skip_existing else []
    docs, queries = read_snapshots(spark, root, skip=done, files=files)
    docs = dedupe_by_id(docs, ["snapshot", "docid"], ["file"])
    passage = assemble_text(strip_ends=True, lower=True, prefix=PASSAGE_PREFIX)
    texts = docs.filter(~is_blank(assemble_text())).select("snapshot", "docid", passage.alias("text"))
    stored = embeddings_or_compute(texts, vectors or f"{out.rstrip('/')}-vectors", encoder, key=("snapshot", "docid"), partition="snapshot")
    asked = written(queries.withColumn("embedding", encoder(normalize_query("query"))))
    run = snapshot_runs(docs, asked, stored, scorer, k)
    lines = to_trec_lines(in_run_order(run, "snapshot"), tag, "snapshot")
    writer = lines.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("compression", "gzip").partitionBy("snapshot").text(out)
