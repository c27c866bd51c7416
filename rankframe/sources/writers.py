"""Writers. Every output is a folder of part files written by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import shuffle_partitions, written
from rankframe.operators.lexical import Index, block_bounds


LINE_DIGITS = 6
"""Decimals of a score in a run line. The rank beside it keeps the order of scores that agree in them."""


def global_order(run: DataFrame, score: str = "score") -> DataFrame:
    return run.orderBy("qid", F.desc(score), "docid")


def write_run(run: DataFrame, path: str) -> None:
    """CSV with a header in each part file, in run order where the run has ranks, replacing what was there."""
    (in_run_order(run) if "rank" in run.columns else run).write.mode("overwrite").option("header", True).csv(path)


ROW_BITS = 33
"""``monotonically_increasing_id`` has the row's place in its partition in this many low bits."""


def with_position(run: DataFrame, score: str = "score") -> DataFrame:
    """The run with ``position``, its row number from 0 in the order of the whole run, in partitions that follow each
    other in that order. The rows are range-partitioned by the whole order, so no query is one task's work; a row's
    position is its place in its partition and the rows of the partitions before, of which there is one number each."""
    order = ["qid", F.desc(score), "docid"]
    placed = written(run.repartitionByRange(shuffle_partitions(run), *order).sortWithinPartitions(*order))
    numbered = placed.withColumn("_id", F.monotonically_increasing_id())
    numbered = numbered.withColumn("_part", F.shiftright("_id", ROW_BITS))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    in_part = F.col("_id") - F.shiftleft("_part", ROW_BITS)
    return numbered.join(F.broadcast(starts), "_part").select(*run.columns, (F.col("_start") + in_part).alias("position"))


def write_ordered_run(run: DataFrame, path: str, score: str = "score") -> None:
    """CSV of the run in one order: part files follow each other by name, rows by ``position``, a column of the file."""
    with_position(run, score).write.mode("overwrite").option("header", True).csv(path)


def write_embeddings(embeddings: DataFrame, path: str) -> None:
    embeddings.write.mode("overwrite").parquet(path)


def to_trec_lines(run: DataFrame, tag: str, *keep: str) -> DataFrame:
    """``value``: ``qid Q0 docid rank score tag``, the score in plain decimals. A null in one of them is an error."""

    def field(name: str, text: Column) -> Column:
        refused = F.raise_error(F.lit(f"null {name} in a run")).cast("string")
        return F.coalesce(text, refused)

    score = F.col("score").cast(f"decimal(38,{LINE_DIGITS})").cast("string")
    named = {name: F.col(name).cast("string") for name in ("qid", "docid", "rank")} | {"score": score}
    qid, docid, rank, score = (field(name, text) for name, text in named.items())
    space = F.lit(" ")
    line = F.concat(qid, F.lit(" Q0 "), docid, space, rank, space, score, F.lit(f" {tag}"))
    return run.select(*keep, line.alias("value"))


def in_run_order(run: DataFrame, *by: str) -> DataFrame:
    """Part files that follow each other by query and rank. The rank is part of the range, so a query
    with very many rows is spread over several files."""
    order = [*by, "qid", "rank"]
    return run.repartitionByRange(shuffle_partitions(run), *order).sortWithinPartitions(*order)


def write_trec_run(run: DataFrame, path: str, tag: str) -> None:
    lines = to_trec_lines(in_run_order(run), tag)
    lines.write.mode("overwrite").option("compression", "gzip").text(path)


def indexable(docid: Column | str = "docid", title: Column | str = "title", abstract: Column | str = "abstract") -> Column:
    """``{"id": …, "contents": title + " " + abstract}``; a missing title is an error, and so is a null
    abstract: give the empty string where the field is missing."""
    title = F.col(title) if isinstance(title, str) else title
    abstract = F.col(abstract) if isinstance(abstract, str) else abstract
    docid = F.col(docid) if isinstance(docid, str) else docid
    refused = F.raise_error(F.concat(F.lit("no title in document "), docid.cast("string"))).cast("string")
    no_abstract = F.raise_error(F.concat(F.lit("null abstract in document "), docid.cast("string"))).cast("string")
    contents = F.concat(F.coalesce(title, refused), F.lit(" "), F.coalesce(abstract, no_abstract))
    return F.to_json(F.struct(docid.alias("id"), contents.alias("contents")))


def to_indexable(docs: DataFrame) -> DataFrame:
    return docs.select(indexable().alias("value"))


def write_indexable(docs: DataFrame, path: str) -> None:
    to_indexable(docs).write.mode("overwrite").text(path)


def write_index(index: Index, path: str) -> None:
    """Index tables. Postings lie in folders by bucket, a hash of the term, so that a search opens only the buckets of its
    terms, and inside by term and block; a term that fills many files is split by document. Block bounds are read from
    the stored postings, document frequencies from the bounds."""
    spark, n = index.postings.sparkSession, shuffle_partitions(index.postings)
    order = ["bucket", "term", "block", "docid"]
    laid = index.postings.repartitionByRange(n, *order).sortWithinPartitions(*order)
    laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    bounds = block_bounds(spark.read.parquet(f"{path}/postings")).repartition("bucket").sortWithinPartitions(*order[:3])
    bounds.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
    stored = spark.read.parquet(f"{path}/blocks")
    terms = stored.groupBy("term").agg(F.sum("n").alias("df")).repartitionByRange(n, "term").sortWithinPartitions("term")
    terms.write.mode("overwrite").parquet(f"{path}/terms")
    index.stats.write.mode("overwrite").parquet(f"{path}/stats")
