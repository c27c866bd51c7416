"""Ranks, top-k and global positions that do not put an unbounded group into one task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DEFAULT_TIE = "docid"
FAN_IN = 256
"""Lists that one reducer merges in a round of ``top_k``."""
CUT_LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def ranking_order(score: str, tie: str = DEFAULT_TIE, tie_desc: bool = False) -> list[Column]:
    return [F.desc(score), F.desc(tie) if tie_desc else F.asc(tie)]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share. Only a local session without one gets a
    folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="rankframe-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """``df`` stored in the checkpoint folder, so that every later reader sees the same rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As ``written``, in Parquet: small for tables of many rows, and a reader takes only the columns it needs."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_rank(
    df: DataFrame,
    score: str = "score",
    *,
    by: Sequence[str] = ("qid",),
    tie: str = DEFAULT_TIE,
    tie_desc: bool = False,
    base: int = 1,
    depth: int | None = None,
    name: str = "rank",
) -> DataFrame:
    """Number the rows of each query from best to worst; equal scores get different ranks.

    ``depth`` is a proven bound on the rows of one query (the k of a top-k run). With it a plain window
    does. Without it one query may hold any share of the rows, so they are range-partitioned by the whole
    ranking order, which splits a heavy query over many tasks, numbered inside each part, and shifted by
    the number of rows in the query's earlier parts.
    """
    order = ranking_order(score, tie, tie_desc)
    if depth is not None:
        number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        return df.withColumn(name, number + F.lit(base - 1) if base != 1 else number)

    keys = [*by, "_part"]
    placed = df.repartitionByRange(shuffle_partitions(df), *[F.asc(c) for c in by], *order)
    placed = written(placed.withColumn("_part", F.spark_partition_id()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        placed.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_shift", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    ranked = placed.withColumn("_inside", inside).join(shifts, keys)
    return ranked.select(
        *df.columns, (F.col("_inside") + F.col("_shift") + F.lit(base - 1)).cast("int").alias(name)
    )


def top_k(
    df: DataFrame,
    k: int,
    score: str = "score",
    *,
    by: Sequence[str] = ("qid",),
    tie: str = DEFAULT_TIE,
    tie_desc: bool = False,
    tasks: int | None = None,
) -> DataFrame:
    """The k best rows of each query, ranked from 1.

    Every task keeps k rows per query before the shuffle. The lists of ``FAN_IN`` tasks at most are merged by one
    reducer: with more ``tasks`` behind ``df`` (as many as a shuffle has partitions, if not given), their lists are merged
    in rounds, and each round leaves one list of k rows for the tasks it merged.
    """
    order = ranking_order(score, tie, tie_desc)
    _cut_before_shuffles(df.sparkSession, k)
    tasks = shuffle_partitions(df) if tasks is None else tasks
    columns, merged = df.columns, 1
    if tasks > FAN_IN:
        df = df.withColumn("_task", F.spark_partition_id())
    while tasks > merged * FAN_IN:
        merged *= FAN_IN
        df = df.withColumn("_group", F.floor(F.col("_task") / merged))
        number = F.row_number().over(Window.partitionBy(*by, "_group").orderBy(*order))
        df = df.withColumn("_n", number).filter(F.col("_n") <= k).drop("_n")
    number = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.select(*columns).withColumn("rank", number).filter(F.col("rank") <= k)


def _cut_before_shuffles(spark: SparkSession, k: int) -> None:
    """Spark cuts a ranking before its shuffle only up to this limit. It changes no result, so a deeper ranking raises it
    for the session."""
    if int(spark.conf.get(CUT_LIMIT)) < k:
        spark.conf.set(CUT_LIMIT, str(k))


HASH_DIGITS = 3


def seeded_hash(seed: int | str, *cols: str) -> Column:
    """Hex digest that decides a repeatable random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def hash_bucket_starts(df: DataFrame, digest: str, weight: Column | None = None) -> DataFrame:
    """Rows before each hash bucket, a bucket being the digest's first digits (at most 4,096 of them).

    Buckets are in digest order, so the running total over them is a global position; the total runs over
    a table of 4,096 rows however long ``df`` is.
    """
    counted = df.groupBy(F.substring(digest, 1, HASH_DIGITS).alias("_bucket")).agg(
        F.sum(F.lit(1) if weight is None else weight).alias("_n")
    )
    before = Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return counted.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
