"""Cross-document line removal: explode normalised lines, hash them, count documents, drop, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.columns import ascii_lower, hash_pair, packed, strip_spaces
from rankframe.llm.skew import skew_join

MADE = ("n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    """The form in which lines are compared: ASCII white space off both ends, A-Z lower-cased."""
    return strip_spaces(ascii_lower(line))


def drop_frequent_lines(df: DataFrame, text: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``df`` with all lines taken out of ``text`` whose key has ``min_chars`` code points or more and stands in
    ``min_docs`` rows or more; also ``n_lines`` before and ``n_dropped``, which replace columns of those names.

    The other lines stay in order, joined by a newline. A null text has one empty line and stays null; a text that
    loses all lines becomes empty. Repeated rows are documents of their own.

    Lines travel as 128-bit hashes. Counts combine before their shuffle, so a line of any share of the documents is
    no hot key there, and its rows are split where they meet the frequent keys; positions are gathered by the
    hash of the whole text, once for all its copies, and the copies are split where they meet them.
    """
    given = df.drop(*MADE)
    rest = [c for c in given.columns if c != text]
    docs = given.select(packed(given, *rest).alias("_row"), F.col(f"`{text}`").alias("_text"))
    whole = F.coalesce("_text", F.lit(""))
    docs = docs.withColumns(dict(zip(("t1", "t2"), hash_pair(whole))))

    keys = F.transform(F.split(whole, "\n"), line_key)
    hashed = F.transform(
        keys, lambda key, i: F.struct(i.alias("at"), (F.char_length(key) >= min_chars).alias("counts"), *hash_pair(key))
    )
    lines = docs.select("t1", "t2", F.filter(hashed, lambda line: line["counts"]).alias("lines"))
    once = F.array_distinct(F.transform("lines", lambda line: F.struct(line["h1"].alias("h1"), line["h2"].alias("h2"))))
    frequent = (
        lines.select(F.inline(once))
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_docs)
        .select("h1", "h2")
    )
    dropped = (
        lines.select("t1", "t2", F.inline("lines"))
        .select("t1", "t2", "at", "h1", "h2")
        .transform(lambda found: skew_join(found, frequent, ["h1", "h2"]))
        .groupBy("t1", "t2")
        .agg(F.collect_set("at").alias("_dropped"))
    )

    split = F.split(whole, "\n")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_dropped")
    kept = F.array_join(F.transform(kept_at, lambda at: F.get(split, at)), "\n")
    made = skew_join(docs, dropped, ["t1", "t2"], "left").select(
        "_row",
        F.when(F.col("_dropped").isNull(), F.col("_text")).otherwise(kept).alias("_text"),
        F.size(split).cast("long").alias("n_lines"),
        F.coalesce(F.size("_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    back = [F.col("_text").alias(text) if c == text else F.col(f"_row.`{c}`") for c in given.columns]
    return made.select(*back, *MADE)
