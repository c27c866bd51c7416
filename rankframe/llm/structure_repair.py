"""Conversation structure repair: the cheapest edits that make the roles follow ``(s?(ua)+)?``, by initials.

A conversation is a string with one symbol for each row, and its edits are the paths of a lattice: a node is the number
of rows consumed and the state of the roles written so far. Keep, Rerole, Delete and Insert are its edges. Bidirectional
Dijkstra searches it from both ends, goes on until no crossing of equal cost can be missing, and takes the crossing
whose concatenated audit, the edits' initials, is least in ASCII order. Memory grows with the rows of a conversation, not
with their square: a node keeps a pointer, not an audit. Texts stay in the JVM, only the symbols go to Python.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.llm.columns import hash_pair, strip_spaces

RETITLE, REMOVE, ADD, UNFINISHED = 3, 4, 3, 3
"""Costs of rerole, delete and insert, and of a truncated row that stays."""
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "x": {}}
"""The state that a row with this initial leads to."""
BACK = {c: [(new, old) for old, new in steps.items()] for c, steps in STEPS.items()}
ROLES = {USER: "user", ASSISTANT: "assistant"}
SOUND, CUT, DOOMED = "suax", "SUAX", "0123"
"""Symbols of sound, truncated, and blank or duplicate rows, by the initial of the role; x is any other."""
INITIALS = dict(zip(SOUND + CUT + DOOMED, SOUND * 3))
REMEMBERED = 64
"""Codes up to this length are solved once in a Python worker; a longer one is solved whenever it comes."""

Node = tuple[int, int]
"""Rows consumed, state."""


def _filled(state: int) -> int:
    """The state after a row whose role the edit chooses."""
    return ASSISTANT if state == USER else USER


def _openers(state: int) -> tuple[int, ...]:
    """The states from which a chosen role leads to ``state``."""
    return {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}.get(state, ())


def _after(code: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    i, state = node
    yield (i, _filled(state)), ADD, "I"
    if i == len(code):
        return
    symbol = code[i]
    yield (i + 1, state), REMOVE, "D"
    if symbol not in DOOMED:
        more = UNFINISHED if symbol in CUT else 0
        yield (i + 1, _filled(state)), RETITLE + more, "R"
        if state in STEPS[INITIALS[symbol]]:
            yield (i + 1, STEPS[INITIALS[symbol]][state]), more, "K"


def _before(code: str, node: Node) -> Iterator[tuple[Node, int, str]]:
    i, state = node
    for old in _openers(state):
        yield (i, old), ADD, "I"
    if i == 0:
        return
    symbol = code[i - 1]
    yield (i - 1, state), REMOVE, "D"
    if symbol not in DOOMED:
        more = UNFINISHED if symbol in CUT else 0
        for old in _openers(state):
            yield (i - 1, old), RETITLE + more, "R"
        for new, old in BACK[INITIALS[symbol]]:
            if new == state:
                yield (i - 1, old), more, "K"


class _Search:
    """One of the two Dijkstra searches. ``link`` has the node before (behind, in reverse) and the edit between.

    Only Keep is free, and it consumes a row: among nodes of one cost, ``way`` takes those with fewer rows first (more, in
    reverse), so that all links of a node at its least cost are known when it settles."""

    def __init__(self, starts: list[Node], way: int):
        self.way, self.cost, self.link, self.settled = way, dict.fromkeys(starts, 0), {}, set()
        self.heap = [(0, way * i, (i, state)) for i, state in starts]
        heapq.heapify(self.heap)

    def top(self) -> float:
        while self.heap and self.heap[0][2] in self.settled:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def pop(self) -> Node:
        node = heapq.heappop(self.heap)[2]
        self.settled.add(node)
        return node

    def offer(self, node: Node, cost: int) -> bool:
        """True if ``cost`` is the node's least so far; an equal one has to be decided by the audits."""
        if cost < self.cost.get(node, float("inf")):
            self.cost[node] = cost
            heapq.heappush(self.heap, (cost, self.way * node[0], node))
            self.link.pop(node, None)
            return True
        return cost == self.cost[node] and node not in self.settled

    def path(self, node: Node) -> list[str]:
        letters = []
        while node in self.link:
            node, letter = self.link[node]
            letters.append(letter)
        return letters


def _less(search: _Search, one: tuple[Node, str], other: tuple[Node, str]) -> bool:
    """Whether the audit through ``one`` is less than that through ``other``, both at the same cost up to one node.

    Both are followed back only to where they part. Along a path (rows, cost) grows, so the node further on steps."""
    (u, a), (v, b) = one, other
    left, right = [a], [b]
    while u != v:
        at_u, at_v = (u[0], search.cost[u]), (v[0], search.cost[v])
        if at_u >= at_v:
            u, letter = search.link[u]
            left.append(letter)
        if at_v >= at_u:
            v, letter = search.link[v]
            right.append(letter)
    return left[::-1] < right[::-1]


def cheapest(code: str) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of a conversation's symbols."""
    n = len(code)
    ahead, behind = _Search([(0, START)], 1), _Search([(n, START), (n, ASSISTANT)], -1)
    best = float("inf") if code else 0
    while ahead.top() + behind.top() <= best:
        if behind.top() <= ahead.top():
            node = behind.pop()
            for old, cost, letter in _before(code, node):
                cost += behind.cost[node]
                if behind.offer(old, cost) and (old not in behind.link or letter < behind.link[old][1]):
                    behind.link[old] = (node, letter)
                best = min(best, cost + ahead.cost.get(old, float("inf")))
        else:
            node = ahead.pop()
            for new, cost, letter in _after(code, node):
                cost += ahead.cost[node]
                if ahead.offer(new, cost) and (new not in ahead.link or _less(ahead, (node, letter), ahead.link[new])):
                    ahead.link[new] = (node, letter)
                best = min(best, cost + behind.cost.get(new, float("inf")))
    # Every cheapest path begins among the nodes that the forward search settled and enters, by one edge, those that the
    # reverse search settled: what follows such a node on a cheapest path was settled before it.
    if (0, START) in behind.settled:
        return int(best), "".join(behind.path((0, START)))
    crossings = (
        ahead.path(node)[::-1] + [letter] + behind.path(new)
        for node in ahead.settled - behind.settled
        for new, cost, letter in _after(code, node)
        if new in behind.settled and ahead.cost[node] + cost + behind.cost[new] == best
    )
    return int(best), "".join(min(crossings))


def applied(code: str, audit: str) -> tuple[list[int], list[str]]:
    """For each row of the repaired conversation, the row it comes from (0 for none) and its new role (empty: its own)."""
    places, roles, i, state = [], [], 0, START
    for letter in audit:
        i += letter != "I"
        if letter == "D":
            continue
        state = STEPS[INITIALS[code[i - 1]]][state] if letter == "K" else _filled(state)
        places.append(0 if letter == "I" else i)
        roles.append("" if letter == "K" else ROLES[state])
    return places, roles


def _solved(code: str) -> tuple[int, str, list[int], list[str]]:
    cost, audit = cheapest(code)
    return cost, audit, *applied(code, audit)


REPAIR = T.StructType(
    [
        T.StructField("cost", T.LongType()),
        T.StructField("audit", T.StringType()),
        T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("roles", T.ArrayType(T.StringType())),
    ]
)


@F.pandas_udf(REPAIR)
def _repairs(codes: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    remembered = lru_cache(maxsize=1 << 16)(_solved)
    for series in codes:
        made = [remembered(c) if len(c) <= REMEMBERED else _solved(c) for c in series]
        yield pd.DataFrame(made, columns=REPAIR.names)


def _fault(text: Column, nth: Column) -> Column:
    said = strip_spaces(text)
    return (
        F.when(said == "", "blank").when(nth > 1, "duplicate").when(~F.substring(said, -1, 1).isin(".", "!", "?"), "truncated")
    )


def repair(messages: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation of ``messages`` (conv_id, turn, role, text): ``gaps, blank, duplicate, truncated,
    illegal, cost, audit`` and ``repaired``, its rows after the edits as an array of (role, text).

    Rows are taken by turn (null first), equal turns by role and text. Each row's first fault counts: blank (nothing but
    ASCII white space), duplicate (role and text of an earlier row), truncated (last other character none of ``.!?``).
    Blank and duplicate rows must be deleted. ``gaps`` are the numbers missing between the least and the largest turn
    (null where their distance exceeds a long), ``illegal`` the adjacent rows whose initials are not su, ua or au. A null
    role or text is one space; a role is kept only by its first character, as it is. Null conversation ids are one
    conversation. Rows for which ``present`` is not true are gone and only name their conversation: one without other rows
    has zeros, an empty audit and no repaired row.

    A conversation's rows meet in one task, as its repaired text is one value of the result. Texts are shuffled once.
    """
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = messages.select("conv_id", there.alias("there"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    rows = rows.withColumns(dict(zip(("h1", "h2"), hash_pair(F.col("role"), F.col("text")))))
    by_turn = Window.partitionBy("conv_id").orderBy(F.desc("there"), F.asc_nulls_first("turn"), "role", "text")
    rows = rows.withColumn("n", F.row_number().over(by_turn))
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "h1", "h2").orderBy("n")))
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"fault": _fault(F.col("text"), F.col("nth")), "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x")})
    sound = F.when(F.col("fault") == "truncated", F.upper("initial")).when(F.col("fault").isNull(), F.col("initial"))
    symbol = F.coalesce(sound, F.translate("initial", SOUND, DOOMED))
    row = F.struct("n", "turn", "role", "text", "initial", symbol.alias("symbol"))
    counted = [F.count_if(F.col("there") & (F.col("fault") == f)).alias(f) for f in ("blank", "duplicate", "truncated")]
    found = rows.groupBy("conv_id").agg(*counted, F.array_sort(F.collect_list(F.when(F.col("there"), row))).alias("rows"))

    turns = F.filter("rows.turn", lambda t: t.isNotNull())
    spread = F.try_subtract(F.array_max(turns), F.array_min(turns))
    gaps = F.when(F.size(turns) > 0, F.try_add(spread, 1 - F.size(F.array_distinct(turns)))).otherwise(0)
    legal = F.regexp_count(F.array_join("rows.initial", ""), F.lit("(?=su|ua|au)"))
    found = found.withColumn("fix", _repairs(F.array_join("rows.symbol", "")))

    def written_row(step: Column) -> Column:
        source = F.get("rows", step["places"] - 1)
        kept = F.when(step["roles"] == "", source["role"]).otherwise(step["roles"])
        return F.struct(kept.alias("role"), F.when(step["places"] > 0, source["text"]).otherwise("").alias("text"))

    return found.select(
        "conv_id",
        gaps.alias("gaps"),
        "blank",
        "duplicate",
        "truncated",
        (F.greatest(F.size("rows") - 1, F.lit(0)) - legal).cast("long").alias("illegal"),
        "fix.cost",
        "fix.audit",
        F.transform(F.arrays_zip("fix.places", "fix.roles"), written_row).alias("repaired"),
    )
