"""Column expressions and row packing that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = " \t\n\x0b\x0c\r"
"""ASCII white space: code points 20 and 09 to 0D, hexadecimal."""


def ascii_lower(text: Column) -> Column:
    """``text`` with A-Z lower-cased and nothing else. Pure ASCII takes the faster built-in."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def strip_spaces(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def words_of(text: Column) -> Column:
    """Maximal runs of anything but ASCII white space; a null text has none."""
    stripped = strip_spaces(F.coalesce(text, F.lit("")))
    return F.when(stripped == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+"))


def hash_pair(*parts: Column) -> list[Column]:
    """Two independent 64-bit hashes, together one 128-bit key: distinct values meet with probability n² / 2¹²⁹."""
    return [F.xxhash64(F.lit(0), *parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")]


def packed(df: DataFrame, *names: str) -> Column:
    """The given columns, all by default, as one struct, so that they clash with no name an operator uses."""
    return F.struct(*[F.col(f"`{c}`") for c in names or df.columns])
