from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rankframe import assemble_text, normalize_query, strip_prefix, token_jaccard, tokenize
from rankframe.functions.text import WHITESPACE, is_blank, strip

TEXTS = [
    "plain words here",
    "  Lead and trail\t\n",
    "a" + "b".join(WHITESPACE) + "c",
    WHITESPACE,
    "",
    "İstanbul ÉCOLE straße",
    "x\r\ny\x1cz\x85w v u　t",
]


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, text string").orderBy("i")


def test_tokens_are_those_of_python(spark):
    got = [r[0] for r in texts(spark, TEXTS).select(tokenize("text")).collect()]
    assert got == [t.lower().split() for t in TEXTS]


def test_strip_is_that_of_python(spark):
    frame = texts(spark, TEXTS).select(strip("text"), is_blank("text"))
    assert [tuple(r) for r in frame.collect()] == [(t.strip(), not t.strip()) for t in TEXTS]


def test_missing_parts_are_empty(spark):
    docs = spark.createDataFrame(
        [(1, "Solar", "Cells"), (2, None, "x"), (3, "x", None), (4, None, None)], "i int, title string, abstract string"
    ).orderBy("i")
    assert [r[0] for r in docs.select(assemble_text()).collect()] == ["Solar Cells", " x", "x ", " "]
    form = assemble_text(strip_ends=True, lower=True, prefix="passage: ")
    assert [r[0] for r in docs.select(form).collect()] == ["passage: solar cells", "passage: x", "passage: x", "passage: "]


def test_query_forms(spark):
    frame = texts(spark, ["  Big Query "])
    modes = ["prefix_lower", "strip", "raw", "prefix"]
    got = list(frame.select(*[normalize_query("text", m) for m in modes]).first())
    assert got == ["query: big query", "Big Query", "  Big Query ", "query: Big Query"]
    with pytest.raises(ValueError):
        normalize_query("text", "other")


def test_prefix_goes_everywhere(spark):
    frame = texts(spark, ["query: what is query: x"])
    assert frame.select(strip_prefix("text")).first()[0] == "what is x"


def test_jaccard(spark):
    pairs = spark.createDataFrame([("a b b", "B c"), ("", ""), ("a", "a")], "q string, d string")
    got = [r[0] for r in pairs.select(token_jaccard(F.col("q"), F.col("d"))).collect()]
    assert got == [pytest.approx(1 / 3), 0.0, 1.0]
