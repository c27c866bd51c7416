"""Byte-level BPE over a sentencepiece model that is serialised straight from a rank file.

No tokenizer is trained. Every vocabulary entry becomes a sentencepiece piece: its bytes are mapped one by one to
printable code points, its score is its negative rank, and the normaliser is the identity. Sentencepiece merges the
best-scored neighbours first, which is the lowest rank first. Texts are cut by the vocabulary's own pattern, every
match is encoded separately, and ids are decoded by the inverse byte map.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import chain

import pyarrow as pa
import regex
import sentencepiece
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIRST_CHAR = 0x4E00
"""Byte b is written as code point FIRST_CHAR + b: 256 assigned letters, none of them white space."""

CACHED_MATCHES = 300_000
"""Matches a worker remembers before it starts anew."""

NORMAL, UNKNOWN, BPE = 1, 2, 2

Ranks = dict[bytes, int]

MADE = ("n_tokens", "ids_sha256", "decoded_sha256")


def read_ranks(lines: Iterable[bytes]) -> Ranks:
    """``base64 rank`` lines as a dictionary."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_CHARS = {b: FIRST_CHAR + b for b in range(256)}


def to_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(_CHARS)


def to_bytes(chars: str) -> bytes:
    return bytes(ord(c) - FIRST_CHAR for c in chars)


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(ranks: Ranks) -> bytes:
    """The sentencepiece model. Pieces lie in the order of their ranks, so a piece's id is its rank; ranks must run
    from 0 without gaps. The unknown piece comes last and never occurs, as every byte is a piece."""
    ordered = sorted(ranks.items(), key=lambda item: item[1])
    if [rank for _, rank in ordered] != list(range(len(ordered))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    if missing := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"bytes without a rank: {missing[:5]}")
    pieces = [
        _field(1, to_chars(token).encode()) + _field(2, -float(rank)) + _field(3, NORMAL) for token, rank in ordered
    ]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN))
    trainer = _field(3, BPE) + _field(4, len(pieces)) + _field(40, len(ordered)) + _field(41, 2**64 - 1)
    trainer += _field(42, 2**64 - 1) + _field(43, 2**64 - 1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts. Matches met before come from a table that is emptied when it holds
    ``CACHED_MATCHES`` entries; the new matches of one text are encoded in one call."""

    def __init__(self, ranks: Ranks, pattern: str):
        self._ranks = ranks
        self._pattern = regex.compile(pattern)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self._bytes = [to_bytes(self._model.id_to_piece(i)) for i in range(len(ranks))]
        self._known: dict[str, tuple[int, ...]] = {}

    def _learn(self, missing: list[str]) -> None:
        """Encode new matches in one call. A match that is an entry itself is that entry, also where merges alone
        would not lead to it."""
        coded = [m.encode("utf-8", "replace") for m in missing]
        merged = self._model.encode([to_chars(data) for data in coded], num_threads=1)
        for match, data, ids in zip(missing, coded, merged):
            rank = self._ranks.get(data)
            self._known[match] = tuple(ids) if rank is None else (rank,)

    def encode(self, text: str | None) -> list[int]:
        matches = self._pattern.findall(text or "")
        known = self._known
        if len(known) >= CACHED_MATCHES:
            known.clear()
        if missing := [m for m in dict.fromkeys(matches) if m not in known]:
            self._learn(missing)
        return list(chain.from_iterable([known[m] for m in matches]))

    def decode(self, ids: Iterable[int]) -> bytes:
        table = self._bytes
        return b"".join([table[i] for i in ids])


@cache
def _codec(ranks_file: str, pattern: str) -> Codec:
    """One codec for a worker and vocabulary. A bare name is a file that the session ships to every executor."""
    with open(ranks_file if "/" in ranks_file else SparkFiles.get(ranks_file), "rb") as lines:
        return Codec(read_ranks(lines), pattern)


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", name: str = "ids") -> DataFrame:
    """``df`` with the token ids of every whole text as ``name``, an array of ints; a column of that name is replaced.

    A null or empty text has no tokens. Nothing is shuffled. ``ranks_file`` is a path that exists on every executor,
    or the bare name of a file given to ``SparkContext.addFile``.
    """
    ids = F.col("_ids")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_file, pattern)
        for part in parts:
            rows = part.column(part.num_columns - 1)
            found = pa.array((codec.encode(t.as_py()) for t in rows), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], [*part.schema.names[:-1], "_ids"])

    given = df.drop(name)
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in given.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    schema = packed.drop("_text").withColumn("_ids", F.lit(None).cast("array<int>")).schema
    return packed.mapInArrow(batches, schema).select("_row.*", ids.alias(name))


def digests(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``encode`` and decode in one pass, keeping only digests: ``df`` without ``text``, with ``n_tokens``,
    ``ids_sha256`` (decimal ids joined by one space) and ``decoded_sha256`` (the bytes decoded from the ids).

    A null text counts as empty: no tokens, digests of the empty string.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_file, pattern)
        for part in parts:
            counts, of_ids, of_bytes = [], [], []
            for t in part.column(part.num_columns - 1):
                found = codec.encode(t.as_py())
                counts.append(len(found))
                of_ids.append(hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(codec.decode(found)).hexdigest())
            made = [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], [*part.schema.names[:-1], *MADE])

    given = df.drop(text, *MADE).columns
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in given]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    schema = packed.drop("_text").selectExpr("_row", "0L n_tokens", "'' ids_sha256", "'' decoded_sha256").schema
    return packed.mapInArrow(batches, schema).select("_row.*", *MADE)

