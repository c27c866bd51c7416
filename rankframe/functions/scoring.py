"""Scoring formulas as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankframe.functions.text import tokenize

SUM_DIGITS = 9
"""A sum over a document's terms is rounded to this many decimals, about eleven significant digits, so that the order
in which it was added up cannot swap two documents whose scores are equal. Scores that are one value each are ranked
as they are."""


def rounded_sum(score: Column) -> Column:
    return F.round(score, SUM_DIGITS)


def idf(n_docs: Column, doc_freq: Column) -> Column:
    return F.log((n_docs - doc_freq + F.lit(0.5)) / (doc_freq + F.lit(0.5)) + F.lit(1.0))


def tf_saturation(tf: Column, doc_len: Column, avg_len: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    norm = F.lit(1.0 - b) + F.lit(b) * doc_len / avg_len
    return tf * F.lit(k1 + 1.0) / (tf + F.lit(k1) * norm)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two stored vectors in double precision; 0.0 where either has no length."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def rrf_term(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (rank + F.lit(k))


def weighted_sum(scores: Sequence[Column], weights: Sequence[float]) -> Column:
    total = F.lit(0.0)
    for score, weight in zip(scores, weights, strict=True):
        total = total + score * F.lit(float(weight))
    return total


def discount(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank + F.lit(1.0))


@dataclass(frozen=True)
class PairScorer:
    """A pair score in two steps: ``prepare`` is made once of every query and every text, ``score`` of a pair of what it
    made. It may be called like any scorer, with a query and a text."""

    prepare: Callable[[Column], Column]
    score: Callable[[Column, Column], Column]

    def __call__(self, query: Column, text: Column) -> Column:
        return self.score(self.prepare(query), self.prepare(text))


def _shared_words(query: Column, text: Column) -> Column:
    shared = F.size(F.array_intersect(query, text))
    return F.coalesce(F.try_divide(shared.cast("double"), F.size(query) + F.size(text) - shared), F.lit(0.0))


token_jaccard = PairScorer(lambda text: F.array_distinct(tokenize(text)), _shared_words)
"""Shared words over all words of the pair; a model-free stand-in for a pair scorer."""
