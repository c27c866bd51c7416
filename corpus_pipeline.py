"""The documents table through five stages; each stage's rows are stored as Parquet and read again by the next.

Rows are never matched by position or by id alone, so null and repeated ids are safe. All stages but the last return
the columns they were given, in order; ``n_chars`` follows the text where lines are taken out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.functions.ranking import shared_folder
from rankframe.llm import byte_bpe, decontaminate, line_dedup, near_dup, quality
from rankframe.llm.columns import packed

RANKS = "byte_bpe_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the line rule reject go; the others stay as they are."""
    return quality.kept_rows(docs, text="text", host="source")


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more of the documents share are taken out; no document goes."""
    rest = [c for c in docs.columns if c != "text"]
    made = line_dedup.drop_frequent_lines(docs.select(packed(docs, *rest).alias("_row"), "text"), min_docs=10)
    changed = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return made.select(*[changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return near_dup.without_near_duplicates(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or a whole shorter item, go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def byte_bpe_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them, by document."""
    return byte_bpe.digests(docs.select("doc_id", "text"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", remove_lines),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe_codes),
]

ORACLE_SQL = None
"""Byte-pair merges have no SQL form; the tests hold ``run`` against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage returns lies in the shared checkpoint folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
