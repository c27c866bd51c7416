"""The driver's tables as corpus, queries, vectors and judgments. ``sql.py`` has the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe import bm25_search, dense_search
from rankframe.functions.sizing import spread
from rankframe.functions.text import tokenize

RUN_K = 200
"""Depth of every expert and of what is made from them."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line is its title."""
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("docid"),
        title.alias("title"),
        F.substr("text", F.length(title) + 2).alias("abstract"),
        F.col("lang").alias("snapshot"),
    )


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with a second copy of every labelled document."""
    docs = corpus(spark, sf_dir).drop("snapshot").withColumn("seq", F.lit(1))
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("docid"))
    second = docs.join(labelled, "docid").withColumn("title", F.concat(F.lit("copy "), "title"))
    return docs.unionByName(second.withColumn("seq", F.lit(2)))


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def short_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two words of every query."""
    return queries(spark, sf_dir).withColumn("query", F.array_join(F.slice(tokenize("query"), -2, 2), " "))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled document is judged for one query; the documents are dealt to the queries in turn."""
    items = queries(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return table(spark, sf_dir, "labels").select(
        (F.col("doc_id") % items).alias("qid"),
        F.lit("0").alias("iter"),
        F.col("doc_id").alias("docid"),
        (F.col("quality") * (F.lit(2) - F.col("toxic"))).alias("relevance"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("docid"), "embedding")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored vectors stand in for an encoder: a query's vector is the one stored under its id."""
    stored = vectors(spark, sf_dir).withColumnRenamed("docid", "qid")
    return queries(spark, sf_dir).join(stored, "qid")


def weighted(df: DataFrame) -> DataFrame:
    """A second encoder: the whole vector, its dimensions weighted 1, 2, 4 in turn. Powers of two are exact in floats."""
    weight = lambda i: F.element_at(F.array(*[F.lit(w).cast("float") for w in (1, 2, 4)]), i % 3 + 1)
    return df.withColumn("embedding", F.transform("embedding", lambda x, i: x * weight(i)))


def dense_run(spark: SparkSession, sf_dir: str, k: int = RUN_K) -> DataFrame:
    return dense_search(query_vectors(spark, sf_dir), vectors(spark, sf_dir), k)


def expert_runs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Two encoders and BM25 over the judged documents."""
    asked, stored = query_vectors(spark, sf_dir), vectors(spark, sf_dir)
    judged = qrels(spark, sf_dir)
    return [
        dense_search(asked, stored, RUN_K),
        dense_search(weighted(asked), weighted(stored), RUN_K),
        bm25_search(queries(spark, sf_dir), corpus(spark, sf_dir), RUN_K, qrels=judged),
    ]


def sparse_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense run with every id times three: some of its documents do not exist."""
    return dense_run(spark, sf_dir).withColumn("docid", F.col("docid") * 3)


def snapshot_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents, queries and vectors by snapshot: a document lies in its language's, a query in that of the document
    with its id."""
    docs = corpus(spark, sf_dir)
    home = docs.select("docid", "snapshot")
    asked = query_vectors(spark, sf_dir).join(home.withColumnRenamed("docid", "qid"), "qid")
    return docs, asked, vectors(spark, sf_dir).join(home, "docid")


def near_tied_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector and a copy of it turned a little: cosines differ in the eighth decimal."""
    stored = vectors(spark, sf_dir).withColumn("embedding", F.col("embedding").cast("array<double>"))
    turned = F.transform("embedding", lambda x, i: F.when(i == 0, x + F.lit(1e-8) * (1 + F.col("docid") % 7)).otherwise(x))
    moved = stored.select((F.col("docid") + 1_000_000).alias("docid"), turned.alias("embedding"))
    return stored.unionByName(moved)
