"""The arithmetic of prediction by partial matching on arrays: byte n-grams, the context trie, code lengths."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd

END = b"\xff"
"""Ends a text and fills the context before its first byte; UTF-8 never has this byte."""

CHUNK = 1 << 20
U64 = np.uint64


def _mask(n_bytes: int) -> np.uint64:
    return U64((1 << 8 * n_bytes) - 1)


def grams(body: bytes, order: int) -> np.ndarray:
    """For every byte of ``body`` and the end after it: its ``order`` predecessors and the byte itself as one number,
    the oldest byte highest."""
    data = np.frombuffer(END * order + body + END, np.uint8).astype(U64)
    count = len(body) + 1
    out = np.zeros(count, U64)
    for i in range(order + 1):
        out <<= U64(8)
        out |= data[i : i + count]
    return out


def chunks(bodies: Iterable[bytes], order: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Grams of many texts by about ``CHUNK`` at a time, the place where each text's part begins, and the number of
    the text each part belongs to. A long text comes in several parts, each with the bytes before it as context."""
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def ready() -> tuple[np.ndarray, np.ndarray, list[int]]:
        starts = np.cumsum([0, *[len(p) for p in parts[:-1]]])
        return np.concatenate(parts), starts, list(owners)

    for number, body in enumerate(bodies):
        for at in range(0, len(body) + 1, CHUNK):
            if at == 0 and len(body) < CHUNK:
                part = grams(body, order)
            else:
                before = (END * order + body[:at])[-order:] if order else b""
                part = grams(before + body[at : at + CHUNK], order)[order:]
                if at + CHUNK <= len(body):
                    part = part[:-1]
            parts.append(part)
            owners.append(number)
            size += len(part)
            if size >= CHUNK:
                yield ready()
                parts, owners, size = [], [], 0
    if parts:
        yield ready()


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes, distinct = pd.factorize(values)
    return np.asarray(distinct, U64), np.bincount(codes, minlength=len(distinct)).astype(np.int64)


class Trie:
    """Contexts of up to ``order`` bytes with the symbols seen after them, from the counts of the longest grams.

    Escape method D: in a context with n occurrences of d symbols, a symbol of count c has (2c - 1) / 2n and the escape
    d / 2n. After an escape the symbols of the longer context are excluded from n and d. Every symbol of a
    context is also one of its shorter contexts, so what an escape leaves over depends on the longer context alone
    and is a number kept with it. Below the empty context all bytes not seen at all share what is left.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, short: tuple[np.ndarray, np.ndarray] | None = None):
        """``short``: n-grams of one context byte with their counts, where ``keys`` are only some of all n-grams."""
        self.order = order
        self.keys: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.log_count: list[np.ndarray] = []
        self.log_total: list[np.ndarray] = []
        self.log_escape: list[np.ndarray] = []
        self.log_left: list[np.ndarray] = []
        self.escapes_below: list[np.ndarray] = []
        below = None
        for j in range(order + 1):
            of_keys, of_counts = (keys, counts) if short is None or j > 1 else short
            level, of = np.unique(of_keys & _mask(j + 1), return_inverse=True)
            count = np.bincount(of, weights=of_counts, minlength=len(level)) if len(level) else np.zeros(0)
            contexts, node = np.unique(level >> U64(8), return_inverse=True)
            n = np.bincount(node, weights=count, minlength=len(contexts))
            d = np.bincount(node, minlength=len(contexts)).astype(float)
            with np.errstate(divide="ignore", invalid="ignore"):
                self.log_total.append(np.log10(2 * n))
                self.log_escape.append(np.log10(d) - np.log10(2 * n))
                self.log_count.append(np.log10(2 * count - 1))
                if below is None:
                    left, none, down = 256.0 - d, np.zeros(len(contexts)), np.zeros(len(contexts))
                    self.log_left.append(np.log10(np.maximum(left, 1)))
                    self.escapes_below.append(none)
                else:
                    b_level, b_count, b_contexts, b_n, b_d, b_down = below
                    in_parent = b_count[np.searchsorted(b_level, level & _mask(j))]
                    parent = np.searchsorted(b_contexts, contexts & _mask(j - 1))
                    n_left = b_n[parent] - np.bincount(node, weights=in_parent, minlength=len(contexts))
                    d_left = b_d[parent] - d
                    escape = np.where(d_left > 0, np.log10(d_left) - np.log10(2 * n_left), 0.0)
                    down = escape + b_down[parent]
                    self.log_left.append(np.log10(np.maximum(2 * n_left, 1)))
                    self.escapes_below.append(down)
            self.keys.append(level)
            self.contexts.append(contexts)
            below = (level, count, contexts, n, d, down)
        node = np.searchsorted(self.contexts[order], self.keys[order] >> U64(8))
        self._whole = self.log_count[order] - self.log_total[order][node]
        self.log_count[order] = self.log_total[order] = np.zeros(0)  # a gram of the full length is looked up whole

    @property
    def bytes(self) -> int:
        return sum(a.nbytes for name in vars(self).values() if isinstance(name, list) for a in name) + self._whole.nbytes

    @staticmethod
    def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(table):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
        return at, table[at] == wanted

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the bytes before it."""
        at, hit = self._find(self.keys[self.order], wanted)
        out = self._whole[at] if len(self._whole) else np.zeros(len(wanted))
        rest = np.flatnonzero(~hit)
        if not len(rest):
            return out
        open_grams = wanted[rest]
        cost = np.zeros(len(rest))
        started = np.zeros(len(rest), bool)
        start_down = np.zeros(len(rest))
        long_left, long_down = np.zeros(len(rest)), np.zeros(len(rest))
        todo = np.arange(len(rest))
        for j in range(self.order, -1, -1):
            gram = open_grams[todo] & _mask(j + 1)
            key_at, found = self._find(self.keys[j], gram)
            node, known = self._find(self.contexts[j], gram >> U64(8))
            new = known & ~started[todo]
            if j < self.order:
                whole, later = found & new, found & ~new
                cost[todo[whole]] = self.log_count[j][key_at[whole]] - self.log_total[j][node[whole]]
                t = todo[later]
                cost[t] += start_down[t] - long_down[t] + self.log_count[j][key_at[later]] - long_left[t]
            enter = new & ~found
            t = todo[enter]
            cost[t] = self.log_escape[j][node[enter]]
            start_down[t] = self.escapes_below[j][node[enter]]
            started[t] = True
            go = known & ~found
            t = todo[go]
            long_left[t], long_down[t] = self.log_left[j][node[go]], self.escapes_below[j][node[go]]
            todo = todo[~found]
            if not len(todo):
                break
        else:
            none = ~started[todo]
            cost[todo] += np.where(none, -np.log10(256.0), start_down[todo] - long_left[todo])
        out[rest] = cost
        return out

    def score(self, bodies: Iterable[bytes], n: int, pairs: tuple[int, int] | None = None) -> np.ndarray:
        """log10 probability of each of ``n`` texts and its end, or the part of it that belongs to contexts whose last
        two bytes, as a number, lie in [pairs[0], pairs[1])."""
        total = np.zeros(n)
        for values, starts, owners in chunks(bodies, self.order):
            codes, distinct = pd.factorize(values)
            distinct = np.asarray(distinct, U64)
            each = self.log10(distinct)
            if pairs:
                last = (distinct >> U64(8)) & U64(0xFFFF)
                each = np.where((last >= pairs[0]) & (last < pairs[1]), each, 0.0)
            each = each[codes]
            np.add.at(total, owners, np.add.reduceat(each, starts))
        return total
