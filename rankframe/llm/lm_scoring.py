"""Language-model scores: a byte-context trie learned from marked documents, and a unigram base over words.

A text's words, A-Z lower-cased and joined by one space, and an end make the string that the model codes byte by byte
(``ppm_model`` has the arithmetic). Learning is one scan that counts byte n-grams and words in every task and sums
them by key; scoring is one scan with the trie in a broadcast. A trie of more than ``max_grams`` n-grams is cut by
the last two context bytes into parts that are broadcast one after the other: every byte belongs to one part.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import written
from rankframe.llm.columns import hash_pair, packed
from rankframe.llm.ppm_model import U64, Trie, chunks, counted

ORDER = 5
MAX_GRAMS = 4_000_000
"""N-grams of the trie in one broadcast, about 50 bytes each."""

FREQUENT_WORDS = 1 << 18
"""Most frequent words whose counts are broadcast; counts of all others are joined."""

HELD_WORDS, HELD_GRAMS = 300_000, 1_500_000

MADE = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def learn(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts (gram, word, n) over the one string column of ``texts``: n-grams of ``order`` context bytes and a
    symbol have a ``gram``, words a ``word``, and the ends, one for each text, neither."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = 0

        def compact() -> None:
            keys, of = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            held[:] = [(keys, np.bincount(of, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

        def grams_out() -> pa.RecordBatch:
            keys, counts = held.pop()
            return _rows(keys.view(np.int64), None, counts)

        def words_out() -> pa.RecordBatch:
            out = _rows(None, list(words), list(words.values()))
            words.clear()
            return out

        for part in parts:
            bodies = []
            for text in part.column(0):
                found = words_of(text.as_py())
                words.update(found)
                bodies.append(b" ".join(found))
                if len(words) >= HELD_WORDS:
                    yield words_out()
            ends += part.num_rows
            for values, _, _ in chunks(bodies, order):
                held.append(counted(values))
                if sum(len(k) for k, _ in held) >= 2 * HELD_GRAMS:
                    compact()
                    if len(held[0][0]) >= HELD_GRAMS:
                        yield grams_out()
        if held:
            compact()
            yield grams_out()
        if words:
            yield words_out()
        yield _rows(None, None, [ends])

    counts = texts.mapInArrow(batches, "gram long, word binary, n long")
    return counts.groupBy("gram", "word").agg(F.sum("n").alias("n")).filter(F.col("n") > 0)


def _rows(grams, words, counts) -> pa.RecordBatch:
    none = [None] * len(counts)
    return pa.RecordBatch.from_arrays(
        [pa.array(none if grams is None else grams, pa.int64()), pa.array(none if words is None else words, pa.binary()), pa.array(counts, pa.int64())],
        ["gram", "word", "n"],
    )


def tries(grams: DataFrame, order: int, max_grams: int) -> Iterator[tuple[int, int, Trie]]:
    """The trie in parts (low, high, trie): contexts whose last two bytes, as a number, lie in [low, high).

    Contexts of fewer than two bytes, at most 65,536 n-grams, are in every part.
    """
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    low_gram = F.col("gram").bitwiseAND(F.lit(0xFFFF))
    short = grams.groupBy(low_gram.alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    sizes = dict(map(tuple, grams.groupBy(pair.alias("pair")).count().collect()))
    cuts, size = [0], 0
    for key in sorted(sizes):
        if size and size + sizes[key] > max_grams:
            cuts.append(key)
            size = 0
        size += sizes[key]
    cuts.append(1 << 16)
    for low, high in zip(cuts, cuts[1:]):
        part = grams if len(cuts) == 2 else grams.filter((pair >= low) & (pair < high))
        got = part.select("gram", "n").toArrow()
        yield low, high, Trie(*_arrays(got), order, _arrays(short))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return table["gram"].to_numpy().astype(np.int64).view(U64), table["n"].to_numpy().astype(np.int64)


def score(
    df: DataFrame,
    learned: Column,
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    order: int = ORDER,
    max_grams: int = MAX_GRAMS,
    frequent_words: int = FREQUENT_WORDS,
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with those of ``MADE``; columns of those names are replaced.

    The model and the word counts are learned from all rows for which ``learned`` is true. ``score`` is the log10
    probability of the text's words and its end under the trie, ``base_score`` under smoothed word frequencies,
    ``n_known`` the tokens (words and one end) that learning saw, ``train_tokens`` all tokens that it saw. A null
    text is empty and has the end alone; without a learned row every byte has probability 1/256. Each row counts,
    repeated or not.
    """
    given = df.drop(*MADE)
    is_learned = F.coalesce(learned, F.lit(False))
    counts = written(learn(given.filter(is_learned).select(F.col(f"`{text}`").alias("text")), order))
    grams, words = counts.filter(F.col("gram").isNotNull()), counts.filter(F.col("gram").isNull()).select("word", "n")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("word").isNull(), F.col("n"))), F.lit(0))).first()
    n_train, n_distinct, n_ends = map(int, total)
    known_words = words.filter(F.col("word").isNotNull())
    top = known_words.orderBy(F.desc("n"), "word").limit(frequent_words).toArrow()
    hot = dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))

    kept = packed(given, *(keep or given.columns))
    source = given.select(kept.alias("_row"), F.col(f"`{text}`").alias("_text"), F.monotonically_increasing_id().alias("_id"))
    parts = tries(grams, order, max_grams)
    low, high, trie = next(parts)
    rest = [_partial(given, text, trie, low, high, order) for low, high, trie in parts]

    base = _scored(source, trie, low, high, order, hot, n_ends)
    one = base.select("_row", "_id", *([] if not rest else ["t1", "t2"]), "n_tokens", "hot_known", "hot_log", "ppm", F.posexplode_outer("rare").alias("at", "rare"))
    first = F.coalesce(F.col("at"), F.lit(0)) == 0
    carried = ["_row", "n_tokens", "hot_known", "hot_log", "ppm", *([] if not rest else ["t1", "t2"])]
    spread = one.select("_id", *[F.when(first, F.col(c)).alias(c) for c in carried], F.col("rare.word").alias("word"), F.col("rare.n").alias("m"))
    met = spread.join(known_words, "word", "left")
    seen = F.coalesce(F.col("n"), F.lit(0))
    summed = met.groupBy("_id").agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in carried],
        F.coalesce(F.sum(F.when(seen > 0, F.col("m"))), F.lit(0)).alias("rare_known"),
        F.coalesce(F.sum(F.col("m") * F.log10(seen + 1)), F.lit(0.0)).alias("rare_log"),
    )
    if rest:
        more = reduce(DataFrame.unionByName, rest).groupBy("t1", "t2").agg(F.sum("more").alias("more"))
        summed = summed.join(more, ["t1", "t2"], "left").withColumn("ppm", F.col("ppm") + F.coalesce("more", F.lit(0.0)))
    below = float(np.log10(n_train + n_distinct + 1))
    return summed.select(
        "_row.*",
        "n_tokens",
        (F.col("hot_known") + F.col("rare_known")).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("hot_log") + F.col("rare_log") - F.col("n_tokens") * F.lit(below)).alias("base_score"),
        F.col("ppm").alias("score"),
    )


def _in_part(trie: Trie, bodies: list[bytes], low: int, high: int) -> np.ndarray:
    return trie.score(bodies, len(bodies), None if (low, high) == (0, 1 << 16) else (low, high))


def _partial(df: DataFrame, text: str, trie: Trie, low: int, high: int, order: int) -> DataFrame:
    """What a further part of the trie adds to each distinct text: (t1, t2, more)."""
    shared = _shared(df, trie)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    t1, t2 = hash_pair(whole)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in parts:
            more = _in_part(model, [b" ".join(words_of(t.as_py())) for t in part.column(2)], low, high)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(more)], ["t1", "t2", "more"])

    source = df.select(t1.alias("t1"), t2.alias("t2"), whole.alias("text"))
    return source.mapInArrow(batches, "t1 long, t2 long, more double").dropDuplicates(["t1", "t2"])


def _shared(df: DataFrame, value):
    return df.sparkSession.sparkContext.broadcast(value)


_RARE = T.ArrayType(T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())]))
_ARROW = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def _scored(source: DataFrame, trie: Trie, low: int, high: int, order: int, hot: dict[bytes, int], n_ends: int) -> DataFrame:
    """(_row, _text, _id) with the trie's part of the score, what the broadcast words give, and the other words."""
    logs = {word: float(np.log10(n + 1)) for word, n in hot.items()}
    shared_trie, shared_hot = _shared(source, trie), _shared(source, pickle.dumps(logs))
    h1, h2 = hash_pair(F.coalesce("_text", F.lit("")))
    source = source.select("_row", "_id", h1.alias("t1"), h2.alias("t2"), "_text")
    made = [("n_tokens", T.LongType()), ("hot_known", T.LongType()), ("hot_log", T.DoubleType()), ("ppm", T.DoubleType()), ("rare", _RARE)]
    schema = T.StructType([*[source.schema[c] for c in source.columns[:-1]], *[T.StructField(*m) for m in made]])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, logs = shared_trie.value, pickle.loads(shared_hot.value)
        end_log = float(np.log10(n_ends + 1))
        for part in parts:
            bodies, tokens, known, log, rare = [], [], [], [], []
            for t in part.column(part.num_columns - 1):
                words = words_of(t.as_py())
                bodies.append(b" ".join(words))
                got = [x for x in map(logs.get, words) if x is not None]
                tokens.append(len(words) + 1)
                known.append(len(got) + (n_ends > 0))
                log.append(sum(got) + end_log)
                other = Counter(w for w in words if w not in logs) if len(got) < len(words) else {}
                rare.append([{"word": w, "n": n} for w, n in other.items()])
            ppm = _in_part(model, bodies, low, high)
            columns = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(log, pa.float64()), pa.array(ppm), pa.array(rare, _ARROW)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], schema.fieldNames())

    return source.mapInArrow(batches, schema)
