"""Text columns: whitespace, tokens, document text, query text.

Whitespace means what Python's ``str.split`` and ``str.strip`` mean by it. Java's ``\\s`` and Spark's
bare ``trim`` cover less, so both the regular expression and the trim set are spelled out here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


WHITESPACE_RUN = r"[\x{9}-\x{d}\x{1c}-\x{1f}\x{85}\p{Z}]+"
"""The same characters: separators are one test per character, where their ranges would be eight."""

QUERY_PREFIX = "query: "
PASSAGE_PREFIX = "passage: "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(WHITESPACE))


def tokenize(c: Column | str) -> Column:
    """Lowercased words between whitespace runs, in order, repeats kept, none empty."""
    return F.array_remove(F.split(F.lower(_col(c)), WHITESPACE_RUN), "")


def assemble_text(
    title: Column | str = "title",
    abstract: Column | str = "abstract",
    *,
    strip_ends: bool = False,
    lower: bool = False,
    prefix: str = "",
) -> Column:
    """``title + " " + abstract`` with a missing part read as the empty string."""
    text = F.concat(
        F.coalesce(_col(title), F.lit("")), F.lit(" "), F.coalesce(_col(abstract), F.lit(""))
    )
    if strip_ends:
        text = strip(text)
    if lower:
        text = F.lower(text)
    return F.concat(F.lit(prefix), text) if prefix else text


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def normalize_query(c: Column | str, mode: str = "prefix_lower") -> Column:
    """Query text as an encoder wants it.

    ``prefix_lower``: prefix, stripped, lowercased. ``strip``: stripped only. ``raw``: untouched.
    ``prefix``: prefix and stripped, case kept (training pairs).
    """
    query = _col(c)
    forms = {
        "prefix_lower": lambda: F.concat(F.lit(QUERY_PREFIX), F.lower(strip(query))),
        "strip": lambda: strip(query),
        "raw": lambda: query,
        "prefix": lambda: F.concat(F.lit(QUERY_PREFIX), strip(query)),
    }
    if mode not in forms:
        raise ValueError(f"unknown query mode {mode!r}; one of {sorted(forms)}")
    return forms[mode]()


def strip_prefix(c: Column | str, prefix: str = QUERY_PREFIX) -> Column:
    """Remove the prefix wherever it occurs, not only at the start."""
    return F.replace(_col(c), F.lit(prefix), F.lit(""))
