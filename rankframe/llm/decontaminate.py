"""Benchmark decontamination: test n-grams in a broadcast hash set, looked up for every window of every text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.columns import hash_pair, packed

WINDOW = 10
BLOCK_BYTES = 8 * 1024 * 1024
"""Benchmark text in one broadcast. A larger benchmark is scanned for in several blocks of this size."""

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_KEEP = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
"""Byte map of the normal form: A-Z lower-cased, all other ASCII but letters and digits to a space."""


def words_of(text: str | None) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters, A-Z lower-cased; a null text has none."""
    return (text or "").encode("utf-8", "replace").translate(_KEEP).split()


class NgramSet:
    """The windows of some test items: words numbered, windows hashed, and the items of every window."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.number: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)]
            if ids:
                size = min(n, len(ids))
                for i in range(len(ids) - size + 1):
                    owners[tuple(ids[i : i + size])].add(item)
        self.owners = {window: sorted(own) for window, own in owners.items()}
        self.hashes = {
            size: np.unique(np.array([_hash(np.array(w, np.uint64), size)[0] for w in self.owners if len(w) == size]))
            for size in {len(w) for w in self.owners}
        }

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged word spans [start, end) covered by windows, and the items found. Hash hits are compared word by
        word before they count."""
        get = self.number.get
        ids = np.array([get(w, 0) for w in words], np.uint64)
        spans, items = [], set()
        for size, known in self.hashes.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate([[0], np.cumsum(ids == 0)])
            starts = np.flatnonzero(unknown[size:] == unknown[:-size])  # windows of known words only
            if not len(starts):
                continue
            found = _hash(ids, size)[starts]
            place = np.minimum(np.searchsorted(known, found), len(known) - 1)
            for start in starts[known[place] == found].tolist():
                own = self.owners.get(tuple(ids[start : start + size].tolist()))
                if own:
                    spans.append((start, start + size))
                    items.update(own)
        return merge(spans), items


def _hash(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` ids."""
    count = len(ids) - size + 1
    out = np.zeros(count, np.uint64)
    for i in range(size):
        out = out * MULTIPLIER + ids[i : i + count] * np.uint64(0xC2B2AE3D27D4EB4F)
        out ^= out >> np.uint64(29)
    return out


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))]
)


def blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> list[DataFrame]:
    """The benchmark cut by a hash of the item into parts of about ``block_bytes`` of text each, by its measured size."""
    items = benchmark.select(
        F.coalesce(F.col(f"`{item_id}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")
    )
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.lit(32)), F.lit(0))).first()[0]
    n = -(-size // block_bytes) or 1
    return [items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def find(
    df: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    n: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    name: str = "found",
) -> DataFrame:
    """``df`` with a struct ``name``: ``n_words`` of the text, ``spans`` of hit words as [start, end) word numbers,
    merged and in order, and ``items``, the sorted ids of all test items with a window in the text.

    A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window. A null text
    has no words and no hits; null ids are the empty string; repeated items or rows are each reported. The test set
    is broadcast. One of more than ``block_bytes`` of text (measured) is broadcast in blocks: each block is one scan of
    ``df``, and their findings are brought together by a 128-bit hash of the text.
    """
    given = df.drop(name)
    source = df.select(packed(given).alias("_row"), F.col(f"`{text}`").alias("_text"))
    parts = blocks(benchmark, item_id, item_text, block_bytes)
    if len(parts) == 1:
        return _scan(source, parts[0], n).select("_row.*", F.col("_found").alias(name))

    key = hash_pair(F.coalesce("_text", F.lit("")))
    texts = source.select("_text", *key)
    hit = [
        _scan(texts.select(F.struct("h1", "h2").alias("_row"), "_text"), part, n)
        .filter(F.size("_found.items") > 0)
        .select("_row.*", F.lit(i).alias("block"), "_found.spans", "_found.items")
        .dropDuplicates(["h1", "h2", "block"])
        for i, part in enumerate(parts)
    ]
    gathered = (
        reduce(DataFrame.unionByName, hit)
        .groupBy("h1", "h2")
        .agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("_items"))
    )
    joined = source.select("_row", "_text", *key).join(gathered, ["h1", "h2"], "left")
    return joined.select("_row.*", _finished("_text", "_spans", "_items").alias(name))


def _scan(source: DataFrame, block: DataFrame, n: int) -> DataFrame:
    """``source`` (_row, _text) as (_row, _found): one pass with the block's n-grams in a broadcast hash set."""
    shared = source.sparkSession.sparkContext.broadcast(NgramSet([(r["item"], r["text"]) for r in block.collect()], n))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in parts:
            rows = []
            for t in part.column(1):
                words = words_of(t.as_py())
                spans, items = known.hits(words)
                rows.append({"n_words": len(words), "spans": [dict(start=a, end=b) for a, b in spans], "items": sorted(items)})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, _ARROW)], ["_row", "_found"])

    return source.mapInArrow(batches, T.StructType([source.schema["_row"], T.StructField("_found", FOUND)]))


@F.pandas_udf(FOUND)
def _finished(text: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
    rows = [
        {
            "n_words": len(words_of(t)),
            "spans": [dict(start=a, end=b) for a, b in merge([(s["start"], s["end"]) for s in ([] if own is None else own)])],
            "items": [] if found is None else list(found),
        }
        for t, own, found in zip(text, spans, items)
    ]
    return pd.DataFrame(rows, columns=["n_words", "spans", "items"])


def without_contaminated(df: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``df`` whose text holds no window of any test item."""
    return find(df, benchmark, name="_hits", **options).filter(F.size("_hits.items") == 0).drop("_hits")


def without_spans(df: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``df`` with the hit words cut out of ``text``, from the first byte of a span's first word to the last of its
    last; what stands between words stays. Texts without a hit are left as they are."""
    return find(df, benchmark, text=text, name="_hits", **options).withColumn(text, _cut(F.col(f"`{text}`"), "_hits.spans")).drop("_hits")


@F.pandas_udf(T.StringType())
def _cut(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(t, own):
        if t is None or not len(own):
            return t
        data = t.encode("utf-8", "replace")
        at = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_KEEP))]
        out, last = [], 0
        for s in own:
            out.append(data[last : at[s["start"]][0]])
            last = at[s["end"] - 1][1]
        return b"".join([*out, data[last:]]).decode()

    return pd.Series([cut(t, own) for t, own in zip(text, spans)])
