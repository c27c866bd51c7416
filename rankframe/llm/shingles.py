"""Shingle sets of texts, minwise values and byte sketches, vectorised inside tasks."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

U64 = np.uint64
WORDS_PER_SHINGLE = 5
CACHED_WORDS = 300_000
PIECE = 4096
_STEP = U64(0x9E3779B97F4A7C15)
_MIX = U64(0xFF51AFD7ED558CCD)


class WordHashes(dict):
    """64-bit hashes of words, remembered until there are ``CACHED_WORDS``."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str | None, hashes: WordHashes, width: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of ``text``, A-Z lower-cased; of fewer words the
    whole sequence is one shingle; without words the set is empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, U64)
    ids = np.fromiter((hashes[w] for w in words), U64, len(words))
    size = min(width, len(words))
    count = len(words) - size + 1
    out = np.full(count, size, U64)
    for i in range(size):
        out = (out ^ ids[i : i + count]) * _STEP
        out ^= out >> U64(32)
    out *= _MIX
    return np.unique(out ^ (out >> U64(33)))


def digest(values: np.ndarray) -> bytes:
    """16 bytes that tell sets apart."""
    return xxhash.xxh3_128_digest(values.tobytes())


class MinHashes:
    """``n`` minwise values of a set, from fixed pseudo-random functions."""

    def __init__(self, n: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self._flip = rng.integers(0, 2**63, (n, 1), U64)
        self._times = rng.integers(0, 2**63, (n, 1), U64) * U64(2) + U64(1)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        best = None
        for at in range(0, len(values), PIECE):
            part = (values[None, at : at + PIECE] ^ self._flip) * self._times
            low = part.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        return best


def sketch(minima: np.ndarray) -> bytes:
    """One byte of each minwise value."""
    return ((minima >> U64(20)) & U64(0xFF)).astype(np.uint8).tobytes()


def estimated(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from sketches along the last axis, corrected for bytes that agree by chance."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def stacked(sketches: Iterable[bytes], n: int) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, n)
