"""Quality rules: per-document base rules, and lines that too many documents of one host share.

A line above its host's limit counts as removed; a document that keeps too few of its words is depleted and rejected.
Exact copies of a text are one document of their host. Lines count whatever their length, as they travel as hashes.
Numbers are folded, so that a page's number or date does not tell its menu apart; digits inside words do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankframe.llm.columns import ascii_lower, hash_pair, packed, strip_spaces, words_of
from rankframe.llm.skew import skew_join

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MADE = (*BASE, "base_failed", "n_frequent_words", "kept")

MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
MIN_DOCS, MIN_LEFT_PERCENT = 10, 30


def line_key(line: Column) -> Column:
    """The form in which lines are compared: A-Z lower-cased, ASCII white space off both ends, and each number that is no
    part of a word as 0."""
    return strip_spaces(F.regexp_replace(ascii_lower(line), r"(?<![\p{L}\p{N}])[0-9]+(?![\p{L}\p{N}])", "0"))


def _starts_repeated(ordered: Column) -> Column:
    """Starts of the windows that equal a neighbour in ``ordered``, windows (h, at) in order of h."""
    pairs = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.size(ordered) + 1), lambda a, b: F.when(a["h"] == b["h"], F.array(a["at"], b["at"])))
    return F.flatten(F.filter(pairs, lambda pair: pair.isNotNull()))


def with_base(df: DataFrame, words: str, text: str) -> DataFrame:
    """``df`` with the columns of ``BASE``, from the array ``words`` and the non-null ``text``."""
    last = F.size(words) - REPEAT_WINDOW
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    windows = F.transform(
        places,
        lambda at: F.struct(F.xxhash64(*[F.get(words, at + i) for i in range(REPEAT_WINDOW)]).alias("h"), at.alias("at")),
    )
    solid = F.filter(F.split(text, "\n"), lambda line: strip_spaces(line) != "")
    df = df.withColumns({"_ordered": F.array_sort(windows), "_solid": solid}).withColumn("_starts", _starts_repeated(F.col("_ordered")))
    covered = F.flatten(F.transform("_starts", lambda at: F.array(*[at + i for i in range(REPEAT_WINDOW)])))
    made = {
        "n_words": F.size(words),
        "word_chars": F.char_length(F.translate(text, WHITE, "")),
        "n_symbols": F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, "")),
        "n_dup_lines": F.size("_solid") - F.size(F.array_distinct("_solid")),
        "n_repeat_words": F.size(F.array_distinct(covered)),
    }
    return df.withColumns({name: value.cast("long") for name, value in made.items()}).drop("_ordered", "_solid", "_starts")


def frequent_words(df: DataFrame, min_docs: int) -> DataFrame:
    """Words in lines above the limits, per distinct (host, t1, t2) of ``df`` (host, text); only texts with any.

    A line is above the limit if it stands in ``min_docs`` distinct documents of the host, however large the host is.
    Texts are collapsed by hash first and lines counted with a partial sum, so neither a hot host nor a common line
    makes a long group.
    """
    keys = F.transform(F.split("text", "\n"), lambda line: F.struct(line_key(line).alias("key"), F.size(words_of(line)).alias("n")))
    lines = F.transform(F.filter(keys, lambda line: line["n"] > 0), lambda line: F.struct(*hash_pair(line["key"]), line["n"].alias("n")))
    texts = df.select("host", *_text_key(), lines.alias("lines")).groupBy("host", "t1", "t2").agg(F.any_value("lines").alias("lines"))
    once = F.array_distinct(F.transform("lines", lambda line: F.struct(line["h1"].alias("h1"), line["h2"].alias("h2"))))
    counts = texts.select("host", F.inline(once)).groupBy("host", "h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = counts.filter(F.col("n_docs") >= min_docs).select("host", "h1", "h2")
    lines_of = texts.select("host", "t1", "t2", F.inline("lines"))
    return (
        skew_join(lines_of, frequent, ["host", "h1", "h2"])
        .groupBy("host", "t1", "t2")
        .agg(F.sum("n").alias("n_frequent_words"))
    )


def _text_key() -> list[Column]:
    h1, h2 = hash_pair(F.col("text"))
    return [h1.alias("t1"), h2.alias("t2")]


def judge(
    df: DataFrame,
    text: str = "text",
    host: str = "source",
    keep: tuple[str, ...] | None = None,
    min_docs: int = MIN_DOCS,
    min_left_percent: float = MIN_LEFT_PERCENT,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with those of ``MADE``; columns of those names are replaced.

    ``base_failed``: fewer than 50 words, or more than half of them in repeated three-word windows. ``kept``: not
    failed, and at least ``min_left_percent`` of the words stand outside lines above the host's limits. A null text
    is empty, a null host is the empty name; repeated rows get the same verdict each.
    """
    given = df.drop(*MADE)
    rows = given.select(
        packed(given, *(keep or given.columns)).alias("_row"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"),
    )
    frequent = frequent_words(rows, min_docs)
    base = with_base(rows.withColumns({"_words": words_of(F.col("text"))}), "_words", "text").select("_row", "host", *_text_key(), *BASE)
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    n_frequent = F.coalesce("n_frequent_words", F.lit(0))
    spare = (F.col("n_words") - n_frequent) * 100 - F.col("n_words") * min_left_percent
    # one condition over both sides of the join: a filter on it must not drag the base rules below the join again
    kept = F.least(-base_failed.cast("double"), spare.cast("double")) >= 0
    on = ["host", "t1", "t2"]
    # like skew_join, by a key that cannot be null: a null check on it would be pushed into one of the two scans of
    # the texts, and they would no longer share their exchange
    part = F.xxhash64(*on).bitwiseAND(F.lit(1))
    both = base.withColumn("_part", part).join(frequent.withColumn("_part", part), [*on, "_part"], "left")
    return both.select(
        "_row.*", *BASE, base_failed.alias("base_failed"), n_frequent.alias("n_frequent_words"), kept.alias("kept")
    )


def kept_rows(df: DataFrame, text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, all columns as they are."""
    rows = df.select(packed(df).alias("_row"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("host"))
    return judge(rows, "text", "host", keep=("_row",), **limits).filter("kept").select("_row.*")
