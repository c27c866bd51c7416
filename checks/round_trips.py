"""Readers and writers over the driver's tables: write to the shared folder, read back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import rankframe as rf
from checks import tables as t
from rankframe.functions.ranking import shared_folder
from rankframe.functions.text import is_blank
from rankframe.operators.encoding import model_encoder
from rankframe.sources import readers, writers


def six(value: Column) -> Column:
    """``value`` to six decimals. Ranked scores have 9 to 12 of their own, and what lies exactly between two numbers of
    six is rounded up by one engine and down by the other; half of a thirteenth decimal takes it off the middle."""
    return F.round(value + F.lit(5e-13), 6)


def fresh(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/{uuid4().hex}"


def one_line_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Queries as a tab-separated file can hold them."""
    return t.queries(spark, sf).withColumn("query", F.replace("query", F.lit("\n"), F.lit(" ")))


def write_lines(df: DataFrame, path: str, sep: str) -> None:
    df.write.option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def write_corpus(docs: DataFrame, path: str, *by: str) -> None:
    """Documents as JSON lines, in the ``.json`` files that Spark writes."""
    writer = docs.select(F.col("docid").alias("id"), "title", "abstract", *by).write
    (writer.partitionBy(*by) if by else writer).json(path)


JSON_FILES = "*.json"


def read_corpus_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    write_corpus(t.corpus(spark, sf), path)
    docs = readers.read_corpus(spark, path, files=JSON_FILES)
    return docs.select("docid", F.md5(rf.assemble_text(lower=True)).alias("bm25_text"))


def read_query_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    write_lines(one_line_queries(spark, sf), path, "\t")
    return readers.read_queries(spark, path)


def read_qrels_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    write_lines(t.qrels(spark, sf).select("qid", "iter", "docid", "relevance"), path, " ")
    return readers.read_qrels(spark, path)


def run_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    writers.write_run(t.dense_run(spark, sf), path)
    return readers.read_run(spark, path).withColumn("score", six(F.col("score")))


def run_order_files(spark: SparkSession, sf: str) -> DataFrame:
    """Positions as the files have them: by file name and line, which is what a reader of one stream sees."""
    path = fresh(spark)
    writers.write_ordered_run(t.dense_run(spark, sf), path)
    lines = spark.read.option("header", True).csv(path).withColumn("file", F.col("_metadata.file_name"))
    place = Window.partitionBy("file").orderBy(F.monotonically_increasing_id())
    lines = lines.withColumn("line", F.row_number().over(place))
    sizes = lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    read = lines.join(starts, "file").select(
        "qid", "docid", (F.col("start") + F.col("line") - 1).alias("place"), F.col("position").cast("long").alias("position")
    )
    return read


def trec_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    writers.write_trec_run(t.dense_run(spark, sf), path, "dense")
    return readers.read_trec_run(spark, path).withColumn("score", six(F.col("score")))


def embedding_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    writers.write_embeddings(t.vectors(spark, sf), path)
    stored = readers.read_embeddings(spark, path)
    total = F.aggregate("embedding", F.lit(0.0), lambda x, y: x + y.cast("double"))
    return stored.select("docid", F.size("embedding").alias("dims"), F.round(total, 6).alias("total"))


def index_files(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark)
    writers.write_index(rf.build_index(t.corpus(spark, sf)), path)
    run = rf.search(readers.read_index(spark, path), t.queries(spark, sf), 10)
    return run.withColumn("score", six(F.col("score")))


def load_counts():
    import numpy as np

    def predict(batch):
        return np.array([[len(text), len(text.split())] for text in batch], dtype=np.float32)

    return predict


COUNTS = model_encoder(load_counts, batch_size=128)


def embeddings_reused(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the judged documents are stored first; the second call encodes only the rest."""
    path = fresh(spark)
    text = rf.assemble_text(strip_ends=True).alias("text")
    docs = t.corpus(spark, sf).select("docid", text).filter(~is_blank("text"))
    rf.embeddings_or_compute(rf.judged_corpus(docs, t.qrels(spark, sf)), path, COUNTS)
    stored = rf.embeddings_or_compute(docs, path, COUNTS)
    parts = [F.col("embedding")[i].cast("long").alias(name) for i, name in enumerate(("chars", "words"))]
    return stored.select("docid", *parts)


def embeddings_changed(spark: SparkSession, sf: str) -> DataFrame:
    """All vectors are stored; then every other document has another text, and only those are encoded anew."""
    path = fresh(spark)
    docs = t.corpus(spark, sf).select("docid", rf.assemble_text(strip_ends=True).alias("text")).filter(~is_blank("text"))
    rf.embeddings_or_compute(docs, path, COUNTS)
    changed = docs.withColumn("text", F.when(F.col("docid") % 2 == 0, F.concat("text", F.lit(" and more"))).otherwise(F.col("text")))
    stored = rf.embeddings_or_compute(changed, path, COUNTS)
    parts = [F.col("embedding")[i].cast("long").alias(name) for i, name in enumerate(("chars", "words"))]
    return stored.select("docid", *parts)


def load_lengths():
    import numpy as np

    def predict(queries, texts):
        return np.array([len(text) - len(query) for query, text in zip(queries, texts)], dtype=np.float64)

    return predict


def rerank_model_hook(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in model behind the hook, its scores kept; the second call finds all of them in the store."""
    path = fresh(spark)
    docs = t.corpus(spark, sf).select("docid", rf.assemble_text(strip_ends=True).alias("text"))
    run, asked = t.dense_run(spark, sf, 20), t.queries(spark, sf)
    for _ in range(2):
        ranked = rf.rerank(run, asked, docs, rf.model_scorer(load_lengths), "blank", depth=20, store=path)
    return ranked


def load_vectors():
    import numpy as np

    def predict(batch):
        return np.array([[len(text) % 7 + 1, len(text.split()) % 5, 1] for text in batch], dtype=np.float32)

    return predict


def dense_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """Queries encoded on the way by a stand-in model, over vectors that it made of the documents."""
    hook = model_encoder(load_vectors)
    docs = t.corpus(spark, sf).select("docid", hook(F.col("title")).alias("embedding"))
    run = rf.dense_search(t.queries(spark, sf), docs, 20, encoder=hook, fmt=lambda query: query)
    return run.withColumn("score", six(F.col("score")))


def snapshot_files(spark: SparkSession, sf: str) -> DataFrame:
    """The whole snapshot job, from files to run files; a second call finds nothing left to do."""
    root = fresh(spark)
    docs = t.corpus(spark, sf)
    write_corpus(docs, f"{root}/documents", "snapshot")
    home = docs.select(F.col("docid").alias("qid"), "snapshot")
    asked = one_line_queries(spark, sf).join(home, "qid")
    asked.write.partitionBy("snapshot").option("sep", "\t").option("quote", '"').option("escape", '"').csv(
        f"{root}/queries"
    )
    for _ in range(2):
        rf.run_snapshots(spark, root, f"{root}/runs", COUNTS, rf.token_jaccard, k=100, files=JSON_FILES)
    return readers.read_trec_run(spark, f"{root}/runs").withColumn("score", six(F.col("score")))


def snapshot_shared_queries(spark: SparkSession, sf: str) -> DataFrame:
    """One file of queries for the snapshots of all documents."""
    root = fresh(spark)
    write_corpus(t.corpus(spark, sf), f"{root}/documents", "snapshot")
    write_lines(one_line_queries(spark, sf), f"{root}/queries", "\t")
    docs, asked = readers.read_snapshots(spark, root, files=JSON_FILES)
    names = docs.select("snapshot").distinct()
    return asked.join(names, "snapshot").select("snapshot", "qid", "query")


ROUND_TRIPS = {
    f.__name__: f
    for f in (
        read_corpus_files,
        read_query_files,
        read_qrels_files,
        run_files,
        run_order_files,
        trec_files,
        embedding_files,
        index_files,
        embeddings_reused,
        embeddings_changed,
        rerank_model_hook,
        dense_encoder,
        snapshot_files,
        snapshot_shared_queries,
    )
}
