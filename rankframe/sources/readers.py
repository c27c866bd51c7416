"""Readers. Ids are strings from the first read on; no schema is inferred."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.operators.lexical import Index

QUERY_SCHEMA = "qid string, query string"
QRELS_SCHEMA = "qid string, iter string, docid string, relevance int"
TREC_SCHEMA = "qid string, q0 string, docid string, rank int, score double, tag string"
CORPUS_FILES = "*.jsonl"


def _plain_text(doc: Column, field: str, guard: bool) -> Column:
    """The field as text. Null, missing and falsy values are empty; another value that is not a string is
    empty under ``guard`` and an error without it."""
    value = F.try_variant_get(doc, f"$.{field}", "variant")
    text = F.variant_get(value, "$", "string")
    kind = F.schema_of_variant(value)
    if guard:
        return F.when(kind == "STRING", text)
    falsy = value.isNull() | F.is_variant_null(value) | text.isin("0", "0.0", "false", "[]", "{}", "-0.0")
    refused = F.raise_error(F.concat(F.lit(f"{field} is not a string: "), text)).cast("string")
    return F.when(kind == "STRING", text).when(~falsy, refused)


def parse_documents(lines: DataFrame, *, guard: bool = True, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines in ``value`` to ``(docid, title, abstract)`` beside the other columns of ``lines``.

    A plain string schema would turn a list into the text of a list, so the line is parsed once into a
    variant and a field taken only when it is a string. ``PERMISSIVE`` keeps a line that is no JSON
    object with an id in ``_corrupt_record``.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError("mode must be FAILFAST or PERMISSIVE")
    kept = [c for c in lines.columns if c != "value"]
    strict = mode == "FAILFAST"
    doc = F.col("_doc")
    parsed = lines.filter(F.trim("value") != "").withColumn(
        "_doc", (F.parse_json if strict else F.try_parse_json)("value")
    )
    docid = F.try_variant_get(doc, "$.id", "string")
    if strict:
        docid = F.coalesce(docid, F.raise_error(F.concat(F.lit("no id in: "), "value")).cast("string"))
    fields = [docid.alias("docid"), *[_plain_text(doc, f, guard).alias(f) for f in ("title", "abstract")]]
    if strict:
        return parsed.select(*fields, *kept)
    corrupt = F.when(docid.isNull(), F.col("value")).alias("_corrupt_record")
    return parsed.select(*fields, *kept, corrupt)


def read_corpus(
    spark: SparkSession, path: str, *, guard: bool = True, mode: str = "FAILFAST", files: str = CORPUS_FILES
) -> DataFrame:
    """``(docid, title, abstract, file)`` from every ``*.jsonl`` under ``path``, or what ``files`` names.

    ``file`` is the order in which ``dedupe_by_id`` lets copies of a document win.
    """
    lines = spark.read.option("pathGlobFilter", files).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"))
    return parse_documents(lines, guard=guard, mode=mode)


def _delimited(spark: SparkSession, sep: str):
    return spark.read.option("sep", sep).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated ``qid, query``. Texts such as ``null`` or ``NA`` stay texts."""
    queries = _delimited(spark, "\t").schema(QUERY_SCHEMA).csv(path)
    return queries.withColumn("query", F.coalesce("query", F.lit("")))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    return _delimited(spark, " ").schema(QRELS_SCHEMA).csv(path)


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; columns are found by name, in any order, and ``rank`` may be missing."""
    raw = _delimited(spark, ",").option("header", True).option("enforceSchema", False).csv(path)
    types = {"qid": "string", "docid": "string", "rank": "int"}
    scores = [c for c in raw.columns if c not in types]
    return raw.select(
        *[F.col(c).cast(types[c]) for c in ("qid", "docid")],
        *[F.col(c).cast("double") for c in scores],
        *[F.col("rank").cast("int")] * ("rank" in raw.columns),
    )


def read_trec_run(spark: SparkSession, path: str) -> DataFrame:
    """Run file lines ``qid Q0 docid rank score tag``, gzipped or not."""
    lines = _delimited(spark, " ").schema(TREC_SCHEMA).csv(path)
    return lines.select("qid", "docid", "score", "rank", "tag")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.withColumn("docid", F.col("docid").cast("string")).withColumn(
        "embedding", F.col("embedding").cast(T.ArrayType(T.FloatType()))
    )


def _by_snapshot(rows: DataFrame, partitioned: bool, alone: str, skip: Sequence[str]) -> DataFrame:
    """Rows with their ``snapshot``; folders in ``skip`` are not read."""
    if not partitioned:
        rows = rows.withColumn("snapshot", F.lit(alone))
    return rows.filter(~F.col("snapshot").isin(list(skip))) if skip else rows


def has_snapshots(spark: SparkSession, path: str) -> bool:
    return "snapshot" in spark.read.text(path).columns


def read_snapshots(
    spark: SparkSession,
    root: str,
    *,
    guard: bool = True,
    snapshot: str = "all",
    skip: Sequence[str] = (),
    files: str = CORPUS_FILES,
) -> tuple[DataFrame, DataFrame]:
    """Documents and queries with a ``snapshot`` column from ``root/documents/snapshot=…/*.jsonl`` and
    ``root/queries/snapshot=…/*``. Queries outside such folders belong to every snapshot of the documents. A
    dataset without snapshot folders is one snapshot, named ``snapshot``."""
    folder = f"{root}/documents"
    partitioned = of_docs = has_snapshots(spark, folder)
    lines = spark.read.option("pathGlobFilter", files)
    lines = lines.schema("value string, snapshot string" if partitioned else "value string").text(folder)
    lines = lines.select("*", F.col("_metadata.file_path").alias("file"))
    docs = parse_documents(_by_snapshot(lines, partitioned, snapshot, skip), guard=guard)

    folder = f"{root}/queries"
    partitioned = has_snapshots(spark, folder)
    schema = f"{QUERY_SCHEMA}, snapshot string" if partitioned else QUERY_SCHEMA
    queries = _by_snapshot(_delimited(spark, "\t").schema(schema).csv(folder), partitioned, snapshot, skip)
    queries = queries.withColumn("query", F.coalesce("query", F.lit("")))
    if partitioned and not of_docs:
        raise ValueError("queries lie in snapshot folders, documents do not")
    if of_docs and not partitioned:  # one set of queries for every snapshot
        queries = queries.drop("snapshot").withColumn("snapshot", F.explode(F.lit(snapshot_names(spark, root, skip))))
    return docs, queries


def snapshot_names(spark: SparkSession, path: str, skip: Sequence[str] = ()) -> list[str]:
    """Names of the ``snapshot=…`` folders under ``path``, or under its ``documents``, from the folder list alone."""
    jvm = spark._jvm
    found = set()
    for place in (f"{path}/documents", path):
        folder = jvm.org.apache.hadoop.fs.Path(place)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(folder):
            names = (entry.getPath().getName() for entry in files.listStatus(folder) if entry.isDirectory())
            found |= {unquote(name.removeprefix("snapshot=")) for name in names if name.startswith("snapshot=")}
    return sorted(found - set(skip))


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in Index._fields])
