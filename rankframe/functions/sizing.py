"""Deciding from measured sizes whether a side of a join may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_BYTES = 256
"""Width assumed for a row of ids and numbers when a caller vouches for the row count."""


def _width(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * F.lit(8) + F.lit(24)
    return F.lit(16)


def measured_bytes(df: DataFrame) -> int:
    """Bytes the rows would take in memory. Runs ``df``; meant for query and judgment sides."""
    width = F.lit(16)
    for field in df.schema.fields:
        width = width + _width(field)
    return df.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("n")).first()["n"]


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int | None = None) -> bool:
    """True when ``df`` is known to stay below ``limit``: from ``rows``, its proven row count, or measured."""
    return (rows * ROW_BYTES if rows is not None else measured_bytes(df)) <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES, rows: int | None = None) -> DataFrame:
    """Hint a broadcast for a side of checked size; any other side is left to a shuffled join."""
    return F.broadcast(df) if fits_broadcast(df, limit, rows) else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal a freshly read table out over the cores when it lies in fewer pieces than there are cores (one
    gzip file, one row group). A table of many pieces is left where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)
