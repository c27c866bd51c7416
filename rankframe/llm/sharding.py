"""K-d tree sharding: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import written
from rankframe.llm.columns import hash_pair, packed
from rankframe.llm.skew import skew_join

BINS = 1024
TOLERANCE = 1 / 8192
"""A median is settled once the bin it lies in holds at most this share of its node's bytes."""

ROWS_PER_BUCKET = 250_000
SCALE = 20
TIE = 32
MADE = ("size", "text_crc32", "shard", "slot")


@dataclass
class Node:
    """A cell of the tree: how many shards it is to become, its bytes and texts, and the cut being looked for."""

    leaves: int
    weight: int
    texts: int
    dim: int = 0
    low: int = 0
    high: int = 1 << (SCALE + TIE)
    below: tuple[int, int] = (0, 0)
    cut: int | None = None

    def step(self, bins: int) -> int:
        return max(1, -(-(self.high - self.low) // bins))

    def narrow(self, histogram: dict[int, tuple[int, int]], bins: int) -> None:
        """Close in on the bin in which the share of the left shards lies; settle on its nearer edge, but no side
        empty, once that is exact enough."""
        target = self.weight * (self.leaves // 2) / self.leaves
        step, last, before = self.step(bins), max(histogram), self.below
        for i in sorted(histogram):
            after = (before[0] + histogram[i][0], before[1] + histogram[i][1])
            if after[0] >= target or i == last:
                break
            before = after
        start, end = self.low + i * step, min(self.low + (i + 1) * step, self.high)
        if step > 1 and histogram[i][0] > self.weight * TOLERANCE:
            self.low, self.high, self.below = start, end, before
            return
        first = before[1] > 0 and (after[1] == self.texts or target - before[0] <= after[0] - target)
        self.cut, self.below = (start, before) if first else (end, after)

    def split(self) -> tuple[Node, Node]:
        """Both halves. Shards go by bytes, but one text is never more than one shard."""
        texts = (self.below[1], self.texts - self.below[1])
        left = min(max(round(self.leaves * self.below[0] / self.weight), 1), self.leaves - 1) if self.weight else 1
        if texts[0] < left:
            left = max(texts[0], 1)
        if texts[1] < self.leaves - left:
            left = self.leaves - max(texts[1], 1)
        return Node(left, self.below[0], texts[0]), Node(self.leaves - left, self.weight - self.below[0], texts[1])


def _pick(values: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), at)


def assign(groups: DataFrame, dims: list[str], n_shards: int, bins: int = BINS) -> DataFrame:
    """``groups`` (weight, h1, and number columns ``dims``) with ``shard``, 0 to ``n_shards`` - 1.

    Every dimension is scaled to 20 bits over the whole table, with 32 bits of ``h1`` below them to tell equal values
    apart in a cut; how wide a cell is in a dimension goes by the scaled values alone. A round is one pass that sums weights in ``bins`` bins of every open cell, so the driver sees
    ``bins`` numbers for a cell and never a row. A cut needs about three rounds, a tree log2(shards) levels.
    """
    ranges = groups.agg(*[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)], F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("texts")).first()
    keys = []
    for i, d in enumerate(dims):
        low, high = float(ranges[f"min_{d}"] or 0), float(ranges[f"max_{d}"] or 0)
        scaled = F.floor((F.col(d).cast("double") - F.lit(low)) * F.lit(((1 << SCALE) - 1) / max(high - low, 1e-9)))
        scaled = F.least(F.greatest(F.coalesce(scaled, F.lit(0)), F.lit(0)), F.lit((1 << SCALE) - 1))
        keys.append((F.shiftleft(scaled.cast("long"), TIE) + F.col("h1").bitwiseAND(F.lit((1 << TIE) - 1))).alias(f"_key{i}"))
    cells = groups.select("*", *keys, F.lit(0).alias("shard"))
    nodes = [Node(n_shards, int(ranges["weight"] or 0), ranges["texts"])]
    while any(node.leaves > 1 for node in nodes):
        spans = cells.groupBy("shard").agg(*[(F.max(F.shiftright(f"_key{i}", TIE)) - F.min(F.shiftright(f"_key{i}", TIE))).alias(f"w{i}") for i in range(len(dims))])
        for row in spans.collect():
            nodes[row["shard"]].dim = max(range(len(dims)), key=lambda i: (row[f"w{i}"], -i))
        keyed = cells.withColumn("_key", F.get(F.array(*[f"_key{i}" for i in range(len(dims))]), _pick([n.dim for n in nodes], F.col("shard")).cast("int")))
        while open_nodes := [i for i, node in enumerate(nodes) if node.leaves > 1 and node.cut is None]:
            low, high = _pick([n.low for n in nodes], F.col("shard")), _pick([n.high for n in nodes], F.col("shard"))
            bin_of = F.floor((F.col("_key") - low) / _pick([n.step(bins) for n in nodes], F.col("shard")))
            inside = keyed.filter(F.col("shard").isin(open_nodes) & (F.col("_key") >= low) & (F.col("_key") < high))
            seen: dict[int, dict[int, tuple[int, int]]] = {i: {} for i in open_nodes}
            sums = inside.groupBy("shard", bin_of.alias("bin")).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("texts"))
            for row in sums.collect():
                seen[row["shard"]][row["bin"]] = (row["weight"], row["texts"])
            for i in open_nodes:
                if seen[i]:
                    nodes[i].narrow(seen[i], bins)
                else:
                    nodes[i].cut = nodes[i].low
        first, made = [], []
        for node in nodes:
            first.append(len(made))
            made += node.split() if node.leaves > 1 else [node]
        right = F.col("_key") >= _pick([2**62 if n.leaves == 1 else n.cut for n in nodes], F.col("shard"))
        cells = keyed.withColumn("shard", (_pick(first, F.col("shard")) + right.cast("int")).cast("int")).drop("_key")
        nodes = made
    return cells.drop(*[f"_key{i}" for i in range(len(dims))])


def giant_texts(groups: DataFrame, weight: int, n_shards: int) -> list[tuple[int, int]]:
    """Texts whose copies outweigh an even share of what they leave to the other shards: each is a shard of its own.

    Only the ``n_shards`` heaviest can be such."""
    giants: list[tuple[int, int]] = []
    for row in groups.orderBy(F.desc("weight"), "h1", "h2").limit(n_shards - 1).select("h1", "h2", "weight").collect():
        if row["weight"] * (n_shards - len(giants)) <= weight or len(giants) == n_shards - 1:
            break
        giants.append((row["h1"], row["h2"]))
        weight -= row["weight"]
    return giants


def _without(groups: DataFrame, giants: list[tuple[int, int]]) -> DataFrame:
    for h1, h2 in giants:
        groups = groups.filter((F.col("h1") != h1) | (F.col("h2") != h2))
    return groups


LEADING = 6


def as_number(df: DataFrame, name: str) -> Column:
    """A column as a number in its own order: a number as it is, anything else by the first ``LEADING`` bytes of its text."""
    if isinstance(df.schema[name].dataType, T.NumericType):
        return F.col(f"`{name}`").cast("double")
    digits = F.rpad(F.substring(F.hex(F.encode(F.col(f"`{name}`").cast("string"), "UTF-8")), 1, 2 * LEADING), 2 * LEADING, "0")
    return F.conv(digits, 16, 10).cast("double")


def shard(
    df: DataFrame,
    n_shards: int | None = None,
    target_bytes: int | None = None,
    text: str = "text",
    row_id: str = "doc_id",
    keep: tuple[str, ...] | None = None,
    dims: tuple[str, ...] = (),
) -> DataFrame:
    """The columns ``keep`` of ``df`` (all by default) with ``size`` (UTF-8 bytes of the text plus 1), ``text_crc32``,
    ``shard`` and ``slot``, gapless from 0 in every shard; columns of those names are replaced.

    Shards are the leaves of a k-d tree over distinct texts, near equal in bytes; equal texts share one. Dimensions: the
    columns ``dims``, each by the least value of a text's rows (null before all), or, if none are named, its smallest
    ``row_id`` (by hash if not a number) and the number of its copies. A text whose copies outweigh an even
    share is a shard of its own. ``target_bytes`` sets the number of
    shards from the table's bytes where ``n_shards`` is not given. A null text is empty; a null id sorts first.
    """
    given = df.drop(*MADE)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2 = hash_pair(whole)
    rows = given.select(
        packed(given, *(keep or given.columns)).alias("_row"),
        F.col(f"`{row_id}`").alias("_id"),
        (F.octet_length(whole) + F.lit(1)).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        h1,
        h2,
        *[as_number(df, d).alias(f"_dim{i}") for i, d in enumerate(dims)],
    )
    named = [f"_dim{i}" for i in range(len(dims))]
    place = F.col("_id").cast("double") if isinstance(df.schema[row_id].dataType, T.NumericType) else F.xxhash64("_id").cast("double")
    groups = written(
        rows.groupBy("h1", "h2").agg(
            F.sum("size").alias("weight"), F.count(F.lit(1)).alias("copies"), F.min(place).alias("place"), *[F.min(d).alias(d) for d in named]
        )
    )
    total = groups.agg(F.sum("weight"), F.sum("copies")).first()
    n_shards = n_shards or max(1, -(-int(total[0] or 0) // target_bytes))
    giants = giant_texts(groups, int(total[0] or 0), n_shards)
    tree = assign(_without(groups, giants), named or ["place", "copies"], n_shards - len(giants)).select("h1", "h2", "shard")
    for i, (h1, h2) in enumerate(giants):
        alone = groups.filter((F.col("h1") == h1) & (F.col("h2") == h2))
        tree = tree.unionByName(alone.select("h1", "h2", F.lit(n_shards - 1 - i).alias("shard")))
    placed = skew_join(rows.drop(*named), tree, ["h1", "h2"])

    n_buckets = max(16, int(total[1] or 0) // (ROWS_PER_BUCKET * n_shards))
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("_id", "size", "h1"), F.lit(n_buckets)))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "h1")) - 1
    numbered = placed.withColumn("_inside", inside).join(F.broadcast(starts), ["shard", "_bucket"])
    return numbered.select("_row.*", "size", "text_crc32", "shard", (F.col("_start") + F.col("_inside")).cast("long").alias("slot"))
