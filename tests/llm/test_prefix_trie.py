"""The trie of conversation prefixes against plain Python."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from rankframe.llm import prefix_trie
from rankframe.llm.queries import QUERIES, rebuilt

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def conversations_by_hand(rows):
    told = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            told.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in told.items()}


def rebuilt_by_hand(told):
    made = {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = told.get(c - c % 20, [])[:h] + own[h:]
    return made


def trie_by_hand(told):
    members = {}
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(who) - 1) * words
    rows = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(told[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        rows.append((min(who), len(p), parent, len(who), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


def branching(seed, n, longest):
    """Conversations that share beginnings of many lengths, some whole; odd turns, ties and repeats among them."""
    pick = random.Random(seed)
    rows, told = [], [[]]
    for conv in pick.sample(range(n * 3), n):
        begin = pick.choice(told)
        begin = begin[: pick.randint(0, len(begin))]
        turns = begin + [(pick.choice(["user", "assistant", None]), pick.choice(["a b", "c", "", None, " d  e f "])) for _ in range(pick.randint(0, longest))]
        told.append(turns)
        rows += [(conv, i if i % 7 else None if i == 0 else i, *t, 0, "x") for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("width", [1, 3, 8])
def test_same_as_by_hand(spark, width):
    rows = branching(width, 60, 9) + [(None, 0, "user", "nobody", 0, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(prefix_trie.turn_ids(df), width=width).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(conversations_by_hand(rows))


def test_rebuilt_conversations(spark):
    rows = branching(5, 80, 6) + [(7, 0, "user", "one turn only", 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = prefix_trie.prefix_trie(*rebuilt(prefix_trie.turn_ids(df))).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(rebuilt_by_hand(conversations_by_hand(rows)))


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op11_prefix_trie"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(rebuilt_by_hand(conversations_by_hand(rows)))


def test_one_long_conversation_and_many_alike(spark):
    """300 turns in blocks of 8, very long texts, a first turn that all share."""
    rows = [(c, i, "user", f"turn {i}" if i else "w " * 200_000, 0, "") for c in (1, 2, 3) for i in range(300 - c)]
    rows += [(c, 0, "user", "w " * 200, 0, "") for c in range(10, 400)]
    got = prefix_trie.prefix_trie(prefix_trie.turn_ids(spark.createDataFrame(rows, SCHEMA))).collect()
    assert sorted(map(tuple, got), key=repr) == trie_by_hand(conversations_by_hand(rows))


def test_empty_tables_and_turnless_members(spark):
    df = spark.createDataFrame([(3, 0, "user", "x", 0, "")], SCHEMA)
    ids = prefix_trie.turn_ids(df.limit(0))
    assert prefix_trie.prefix_trie(ids).count() == 0
    only = prefix_trie.prefix_trie(ids, spark.createDataFrame([(5,), (4,)], "conv_id long")).collect()
    assert [tuple(r) for r in only] == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]


def test_rollup_is_the_plan(spark):
    ids = prefix_trie.turn_ids(spark.range(3).select(F.col("id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("u").alias("role"), F.lit("t").alias("text")))
    plan = prefix_trie._rollup(prefix_trie._blocks(ids, ids.select("conv_id"), 4), 4, "count(*) n")._jdf.queryExecution().executedPlan().toString()
    assert "Expand" in plan and "CartesianProduct" not in plan
