"""The trie of conversation prefixes, from ROLLUPs over positional turn-id columns.

A conversation becomes rows of ``width`` turn-id columns. ``GROUP BY block, prior node, ROLLUP(t1 … tn)`` makes a group
of every prefix of a block, and ``grouping_id`` tells its length. Longer conversations go on in further blocks, keyed by
the node that their earlier blocks end at, so one ROLLUP serves all blocks and depths. Aggregates combine before the
shuffle: neither the root nor a first turn that everybody shares is a hot key.

A node's key is the exclusive or of two 64-bit hashes of (position, turn) over its path. A prefix's key needs no walk
along the path, and a node's key without its last turn is its parent's. Two paths meet with probability n² / 2¹²⁹.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import written
from rankframe.llm.columns import hash_pair, words_of
from rankframe.llm.skew import skew_join

WIDTH = 8
KEY = ["k1", "k2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_ids(messages: DataFrame) -> DataFrame:
    """``(conv_id, pos, h1, h2, words)``: the position of each turn, from 0, a hash of its role and text, and the number
    of its words. Texts go no further than this.

    Turns are ordered by ``turn``, null first; equal ones by role and then by hash. A null role or text is empty. Rows
    without a conversation id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    words = F.size(words_of(text)).cast("long").alias("words")
    rows = messages.select("conv_id", "turn", role.alias("role"), *hash_pair(role, text), words).filter("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "h1", "h2")
    return rows.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), "h1", "h2", "words")


def _columns(width: int) -> list[str]:
    return [f"t{i}" for i in range(1, width + 1)]


def _blocks(turns: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """``(conv_id, block, p1, p2, x1, x2, t1 …)``: p is the key of the node at the block's start, x the block's share of
    the keys after it. A conversation without turns is an empty first block."""
    spot = F.struct(F.xxhash64(F.lit(0), "pos", "h1", "h2").alias("a"), F.xxhash64(F.lit(1), "pos", "h1", "h2").alias("b"), "words")
    spots = turns.select("conv_id", F.expr(f"pos div {width}").alias("block"), (F.col("pos") % width).alias("slot"), spot.alias("t"))
    at = [F.max(F.when(F.col("slot") == i, F.col("t"))).alias(c) for i, c in enumerate(_columns(width))]
    made = spots.groupBy("conv_id", "block").agg(F.bit_xor("t.a").alias("x1"), F.bit_xor("t.b").alias("x2"), *at)
    silent = members.join(turns.select("conv_id").distinct(), "conv_id", "left_anti")
    zero = F.lit(0).cast("long")
    made = made.unionByName(silent.select("conv_id", zero.alias("block"), zero.alias("x1"), zero.alias("x2")), allowMissingColumns=True)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    prior = {f"p{i}": F.coalesce(F.bit_xor(f"x{i}").over(before), zero) for i in (1, 2)}
    return made.withColumns(prior)


def _rollup(rows: DataFrame, width: int, aggregates: str) -> DataFrame:
    """One row for each prefix in ``rows``: its path inside the block, its level there, its key, and ``aggregates``.

    A block that ends early has null columns; ROLLUP groups by those too, and such groups are no prefixes.
    """
    path = ", ".join(_columns(width))
    groups = rows.sparkSession.sql(
        f"select block, p1, p2, {path}, {width} - bit_count(grouping_id()) as level, {aggregates} "
        f"from {{rows}} group by block, p1, p2, rollup({path})",
        rows=rows,
    )
    last = F.get(F.array(*_columns(width)), F.col("level") - 1)
    found = groups.withColumn("last", last).filter("last is not null or (block = 0 and level = 0)")
    return found.withColumns({"k1": _key("p1", "a", width), "k2": _key("p2", "b", width)})


def _key(prior: str, half: str, width: int) -> Column:
    parts = [F.coalesce(F.col(f"{c}.{half}"), F.lit(0)) for c in _columns(width)]
    return reduce(lambda key, part: key.bitwiseXOR(part), parts, F.col(prior))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each key, of rows sorted by key and id; only the hash's state is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for k1, k2, conv in zip(*(column.to_pylist() for column in batch.columns)):
            if (k1, k2) == now:
                state.update(f",{conv}".encode())
                continue
            if now is not None:
                done.append((*now, state.hexdigest()))
            now, state = (k1, k2), hashlib.sha256(str(conv).encode())
        yield _digest_rows(done)
    if now is not None:
        yield _digest_rows([(*now, state.hexdigest())])


def _digest_rows(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    kinds = (pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*KEY, "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """The nodes of the trie of all conversations, the root among them, one row each.

    ``turns`` is ``(conv_id, pos, h1, h2, words)`` with positions 0, 1, 2 … in every conversation, as ``turn_ids`` makes
    it. ``members`` names all conversations, where some have no turn: these are members of the root alone. The result is
    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of the subtree, top included), ``saved_tokens`` (over the subtree, the
    words of a node's last turn times its members but one) and ``ends_sha256`` (of the ids of the conversations that end
    at the node, ascending, joined by commas). Without conversations there is no node.

    Totals of a subtree are a second ROLLUP, over the nodes. What lies in later blocks is credited to the conversation
    that owns it, the smallest member: it passes through all nodes above, so its own block rows carry the sums there.
    """
    members = (turns if members is None else members).select("conv_id").distinct()
    path = _columns(width)
    blocks = written(_blocks(turns, members, width))
    found = _rollup(blocks, width, "count(*) as n_convs, min(conv_id) as conv_id")
    nodes = written(
        found.select(
            "block", "p1", "p2", *path, (F.col("block") * width + F.col("level")).alias("depth"), *KEY, "n_convs", "conv_id",
            F.col("k1").bitwiseXOR(F.coalesce("last.a", F.lit(0))).alias("u1"),
            F.col("k2").bitwiseXOR(F.coalesce("last.b", F.lit(0))).alias("u2"),
            F.coalesce("last.words", F.lit(0)).alias("words"),
        )
    )
    below = nodes.filter("depth > 0")
    children = below.groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, KEY, "left").fillna({"n_children": 0})
    nodes = nodes.withColumns({"saved": (F.col("n_convs") - 1) * F.col("words"), "leaf": (F.col("n_children") == 0).cast("long")})

    owned = nodes.groupBy("conv_id", "block").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    long_ones = blocks.filter(F.col(path[-1]).isNotNull() | (F.col("block") > 0)).join(owned, ["conv_id", "block"], "left")
    later = Window.partitionBy("conv_id").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    credit = long_ones.select("block", "p1", "p2", *path, F.sum("saved").over(later).alias("saved"), F.sum("leaf").over(later).alias("leaf"))
    parts = nodes.select(*credit.columns).unionByName(credit.filter("leaf is not null or saved is not null"))
    totals = _rollup(parts, width, "sum(leaf) as n_leaves, sum(saved) as saved_tokens").select(*KEY, "n_leaves", "saved_tokens")

    stops = blocks.groupBy("conv_id").agg(F.bit_xor("x1").alias("k1"), F.bit_xor("x2").alias("k2")).select(*KEY, "conv_id")
    stops = stops.repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")
    ends = stops.mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")

    parents = nodes.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("conv_id").alias("parent"))
    whole = nodes.join(totals, KEY).join(ends, KEY, "left")
    return skew_join(whole, parents, ["u1", "u2"], "left").select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
