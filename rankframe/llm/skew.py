"""Joins that one key with a large share of the rows does not put into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def skew_join(many: DataFrame, few: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which has at most one row for each key; ``how`` is inner, left or left_anti.

    A side that was just grouped by the keys would be joined where it lies, and adaptive execution splits a partition
    only if both sides were dealt out for the join. A further key, made from the others, has both dealt out, so a key
    of any share of ``many`` is split over tasks, each with the one row of ``few``.
    """
    part = F.pmod(F.xxhash64(*on), F.lit(2)).cast("int")
    return many.withColumn("_part", part).join(few.withColumn("_part", part), [*on, "_part"], how).drop("_part")
