"""Main text of web pages: page structure, and what a host repeats on most of its pages.

A page is cut into blocks of three kinds. ``chrome``: inside an excluded element, never text. ``main``: inside an
article or main element and in none of the excluded ones. ``open``: neither. What stands on more than half of the
distinct contents of a host is boilerplate: in the stream of open blocks every run of ``RUN`` tokens and so every longer
one, of main blocks only whole ones of ``LONG`` tokens or more. Pages count once for each distinct content, so copies of an
article are no evidence, and a host of fewer than three contents has no boilerplate.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import written
from rankframe.functions.sizing import broadcast_if_small
from rankframe.llm.columns import hash_pair, packed
from rankframe.llm.skew import skew_join

RUN = 6
"""Tokens of the shortest run of open blocks that can be boilerplate."""

LONG = 32
"""Tokens of the shortest main block that can be boilerplate."""

LEAST_CONTENTS = 3

RAW = "script|style|noscript|template|textarea|svg|math|iframe|object|canvas|select"
MAIN = {"article", "main"}
EXCLUDED = {"head", "title", "nav", "header", "footer", "aside", "form", "button", "dialog", "menu"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
EXCLUDED_NAMES = re.compile(
    r"(?:(?:site|page|main|global|top|bottom|left|right|article|post|user|reader)[-_])?"
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|newsletter|popup|modal|nav\w*|menu|breadcrumbs?|sidebar|"
    r"widget|share|sharing|social|comments?|replies|disqus|related|footer|header|login|signup|subscribe|pagination|skip)(?:[-_].*)?",
    re.I,
)
"""What a class or id begins with, perhaps after the name of a part of the page."""

EXCLUDED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}

_NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
_STOP = re.compile("[>\"']")
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW.split("|")}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)

CHROME, OPEN_ZONE, MAIN_ZONE = 0, 1, 2


def _is_excluded(tag: str, attributes: str) -> bool:
    if tag in EXCLUDED:
        return True
    for name, value in _ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        value = value.strip("\"'")
        if value.lower() in EXCLUDED_ROLES if name.lower() == "role" else any(map(EXCLUDED_NAMES.fullmatch, value.split())):
            return tag not in ("html", "body")
    return False


class _Scanner:
    """Tags of a page, in one pass: what has been looked for once and is not ahead is not looked for again."""

    def __init__(self, source: str):
        self.source, self.missing = source, set()

    def _ahead(self, what: str, at: int) -> int:
        found = -1 if what in self.missing else self.source.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def _end(self, at: int) -> int:
        """Place of the ``>`` that ends a tag, not one in quotes. A quote that nothing closes is a plain character."""
        while stop := _STOP.search(self.source, at):
            at = stop.end()
            if stop[0] == ">":
                return stop.start()
            close = self._ahead(stop[0], at)
            at = at if close < 0 else close + 1
        return -1

    def tags(self) -> Iterator[tuple[int, int, str, bool, str]]:
        """(start, end, name, whether it closes, attributes) of each tag; the name is empty for what is to be left out."""
        source, at = self.source, 0
        while (start := source.find("<", at)) >= 0:
            if source.startswith("<!--", start):
                close = self._ahead("-->", start + 4)
                at = len(source) if close < 0 else close + 3
                yield start, at, "", False, ""
                continue
            name = _NAME.match(source, start)
            other = name is None and source.startswith(("<!", "<?"), start)
            if name is None and not other:
                at = start + 1
                continue
            end = self._ahead(">", start) if other else self._end(name.end())
            if end < 0:
                return  # nothing ends a tag from here on: all the rest is text
            at = end + 1
            tag = "" if other else name[1].lower()
            if tag in _CLOSING and source[start + 1] != "/":
                close = _CLOSING[tag].search(source, at)
                at = close.end() if close else len(source)
                tag = ""
            yield start, at, tag, source[start + 1] == "/", source[name.end() : end] if tag else ""


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(kind, text) of each block with text, in page order: references decoded, white space single, ends trimmed. Takes
    time in proportion to the page, whatever is broken in it."""
    out: list[tuple[int, str]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = [("", OPEN_ZONE)]
    depth: Counter[str] = Counter()
    source = page or ""

    def flush() -> None:
        text = " ".join(html.unescape("".join(pieces)).split())
        if text:
            out.append((stack[-1][1], text))
        pieces.clear()

    last = 0
    for start, end, tag, closes, attributes in _Scanner(source).tags():
        pieces.append(source[last:start])
        last = end
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if closes:
            if depth[tag]:
                at = len(stack) - 1
                while stack[at][0] != tag:
                    at -= 1
                if any(stack[i][1] != stack[at - 1][1] for i in range(at, len(stack))):
                    flush()
                depth.subtract(name for name, _ in stack[at:])
                del stack[at:]
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        zone = stack[-1][1]
        if zone != CHROME and _is_excluded(tag, attributes):
            flush()
            zone = CHROME
        elif zone == OPEN_ZONE and tag in MAIN:
            zone = MAIN_ZONE
        if tag == "p" and stack[-1][0] == "p":
            depth[stack.pop()[0]] -= 1  # a paragraph ends the one before it
        if zone != stack[-1][1] or tag not in INLINE:
            stack.append((tag, zone))
            depth[tag] += 1
    pieces.append(source[last:])
    flush()
    return out


SHORT_RUN, WHOLE = 0, 1
_UNIT = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("u1", T.LongType()), T.StructField("u2", T.LongType()), T.StructField("at", T.IntegerType())])
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("u1", pa.int64()), ("u2", pa.int64()), ("at", pa.int32())]))


def _two(text: str) -> tuple[int, int]:
    digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()
    return struct.unpack("<qq", digest)


def units(parts: list[tuple[int, str]], run: int) -> list[dict]:
    """What of a page's blocks can be boilerplate: runs at a token of its open blocks, and long main blocks."""
    tokens = [token for zone, text in parts if zone == OPEN_ZONE for token in text.split(" ")]
    found = [(SHORT_RUN, " ".join(tokens[at : at + run]), at) for at in range(len(tokens) - run + 1)]
    found += [(WHOLE, text, at) for at, (zone, text) in enumerate(parts) if zone == MAIN_ZONE and text.count(" ") >= LONG - 1]
    return [dict(zip(("kind", "u1", "u2", "at"), (kind, *_two(text), at))) for kind, text, at in found]


def _narrow(source: DataFrame, run: int) -> DataFrame:
    """(host, h1, h2, _html) as (host, h1, h2, c1, c2, units); c names the page's main and open text, null if it has none."""

    def batches(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pages:
            made = []
            for page in part.column(part.num_columns - 1):
                told = blocks(page.as_py())
                content = "\n".join(text for zone, text in told if zone != CHROME)
                made.append((*(_two(content) if content else (None, None)), units(told, run)))
            c1, c2, found = zip(*made) if made else ((), (), ())
            columns = [*part.columns[:-1], pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(found, _ARROW)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "c1", "c2", "units"])

    more = [T.StructField("c1", T.LongType()), T.StructField("c2", T.LongType()), T.StructField("units", T.ArrayType(_UNIT))]
    return source.mapInArrow(batches, T.StructType([*[source.schema[c] for c in source.columns[:-1]], *more]))


def boilerplate(narrow: DataFrame, run: int = RUN) -> DataFrame:
    """Per page (h1, h2) with any: the tokens ``covered`` of its open blocks, and the main blocks ``repeated``.

    ``narrow`` has (host, h1, h2, c1, c2, units). Pages collapse by the hash of their main and open text first, and units
    are counted with a partial sum, so a unit on every page of a hot host is one row for each task.
    """
    told = narrow.filter(F.col("c1").isNotNull())
    totals = told.select("host", "c1", "c2").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("of")).filter(F.col("of") >= LEAST_CONTENTS)
    with_units = told.filter(F.size("units") > 0)
    keys = F.transform("units", lambda u: F.struct(u["kind"].alias("kind"), u["u1"].alias("u1"), u["u2"].alias("u2")))
    contents = with_units.groupBy("host", "c1", "c2").agg(F.any_value(F.array_distinct(keys)).alias("keys"))
    unit = ["host", "kind", "u1", "u2"]
    counts = contents.select("host", F.inline("keys")).groupBy(*unit).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    frequent = skew_join(counts, totals, ["host"]).filter(F.col("n") * 2 > F.col("of")).select(*unit)
    found = skew_join(with_units.select("host", "h1", "h2", F.inline("units")), frequent, unit)
    of = {kind: F.collect_set(F.when(F.col("kind") == kind, F.col("at"))) for kind in (SHORT_RUN, WHOLE)}
    starts = found.groupBy("h1", "h2").agg(of[SHORT_RUN].alias("starts"), of[WHOLE].alias("repeated"))
    covered = F.array_distinct(F.flatten(F.transform("starts", lambda at: F.sequence(at, at + run - 1))))
    return starts.select("h1", "h2", covered.alias("covered"), "repeated")


def assembled(parts: list[tuple[int, str]], covered: set[int], repeated: set[int]) -> str:
    """The blocks that are text, in order: main ones whole, open ones without their covered tokens."""
    out, at = [], 0
    for i, (zone, text) in enumerate(parts):
        if zone == OPEN_ZONE:
            tokens = text.split(" ")
            out.append(" ".join(token for k, token in enumerate(tokens, at) if k not in covered) if covered else text)
            at += len(tokens)
        elif zone == MAIN_ZONE and i not in repeated:
            out.append(text)
    return " ".join(filter(None, out))


def extract(pages: DataFrame, url: str = "url", page: str = "html", keep: tuple[str, ...] | None = None, run: int = RUN) -> DataFrame:
    """The columns ``keep`` of ``pages`` (all by default) with ``text``, the page's blocks in order joined by one
    space (empty if none), and ``n_chars``, its code points; columns of those names are replaced.

    A null page has no text, a null url the empty host; equal rows are one page and get the same text each. A page of
    any length is read whole, in time in proportion to it. Pages are parsed twice, for the hashes of what may be
    boilerplate, which are all that is shuffled, and for the text; the boilerplate found is broadcast if it measures
    little, else pages meet it in a shuffled join.
    """
    given = pages.drop("text", "n_chars")
    kept = packed(given, *(keep or given.columns))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(f"`{url}`"), F.lit("")), r"^[^:]*://([^/?#]*)", 1))
    source = given.select(
        kept.alias("_row"), host.alias("host"), *hash_pair(F.coalesce(F.col(f"`{url}`"), F.lit("")), F.coalesce(F.col(f"`{page}`"), F.lit(""))),
        F.col(f"`{page}`").alias("_html"),
    )
    narrow = written(_narrow(source.select("host", "h1", "h2", "_html"), run))
    found = broadcast_if_small(written(boilerplate(narrow, run)))
    marked = source.join(found, ["h1", "h2"], "left").select("_row", "_html", "covered", "repeated")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = zip(*(part.column(i).to_pylist() for i in (1, 2, 3)))
            texts = [assembled(blocks(source), set(covered or ()), set(repeated or ())) for source, covered, repeated in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["_row", "text"])

    text = marked.mapInArrow(batches, T.StructType([marked.schema["_row"], T.StructField("text", T.StringType())]))
    return text.select("_row.*", "text", F.char_length("text").cast("long").alias("n_chars"))
