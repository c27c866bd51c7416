"""Embedding near-duplicates: all pairs at a cosine threshold, exactly, by dual traversal of cover trees.

Distance is the angle. A tree's levels are nested and halve their radius: a node's centre is a vector of its own, its
children's centres are further apart than their level's radius, and its covering radius is the largest angle from the
centre to any vector below. A pair of nodes whose centres are further apart than both radii and the threshold's angle has
no pair within the threshold; one that is closer than the angle less both radii has nothing else, and is counted
without a look at its vectors. All other pairs of nodes are split, down to products of leaf blocks.

The top of the tree is built from a bounded sample and cuts the vectors into cells; neighbouring small cells share a
stripe, a large cell is dealt over several. Every stripe becomes one subtree, built once. Pairs of stripes that the
cells' bounds leave are traversed in tiles of stripes against stripes. A tile returns counts and the links of a spanning
forest, at most one row for each vector in it, whatever the number of pairs.

Vectors without structure leave nothing to prune, and the work is then the product of all stripes; so it is for every
exact join. The sample decides the speed alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import written
from rankframe.llm.columns import hash_pair
from rankframe.llm.components import components
from rankframe.llm.skew import skew_join

SAMPLE = 2048
"""Vectors, least hashes first, from which the top of the tree is built in the driver."""
STRIPE = 2048
"""Distinct vectors that one subtree is meant to hold; it holds fewer than twice as many."""
LEAF = 32
"""Nodes of this many vectors at most are not divided further, if their radius is ``FINEST`` or less."""
FINEST = math.pi / 16
"""Also the radius of the last level of the sample's tree."""
TILE_BYTES = 32 * 1024 * 1024
"""Vectors on one side of a tile take about this much, in doubles."""
LEAST_TILES = 8
"""Sides into which a small input is cut all the same, for the sake of many tasks."""
SLACK = 1e-6
"""Bounds are trusted beyond this angle; what is closer is compared."""
DOUBTFUL = 1e-9
"""Products this close to the threshold are decided by the vectors as given."""
FOLD = 1 << 20
"""Links held before they are reduced to a spanning forest."""
SLOT = 1 << 20
"""A vector's address is its stripe times this, plus its place."""


@dataclass
class Tree:
    """A cover tree in flat arrays. ``order`` are the places of the given vectors in tree order; node ``i`` holds those
    from ``lo[i]`` to ``hi[i]``, the first of which is its centre, and its children are ``first[i]`` to ``last[i]``
    (none for a leaf)."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray


def unit_rows(raw: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision. A power of two comes out first, so that no square overflows."""
    raw = raw.astype(np.float64)
    _, power = np.frexp(np.abs(raw).max(axis=1, keepdims=True))
    raw = np.ldexp(raw, -power)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _net(units: np.ndarray, rows: np.ndarray, radius: float) -> list[np.ndarray]:
    """``rows`` divided among centres that are further apart than ``radius``, each first in its part; the first row is a
    centre."""
    parts, reach = [], math.cos(radius)
    while len(rows):
        near = units[rows] @ units[rows[0]] >= reach
        near[0] = True
        parts.append(rows[near])
        rows = rows[~near]
    return parts


def cover_tree(units: np.ndarray, finest: float = 1e-7) -> Tree:
    """The tree of unit vectors, down to the level of radius ``finest``."""
    made: list[list] = [[np.arange(len(units)), 0.0, 0, 0]]  # vectors, radius, first child, last child
    at = 0
    while at < len(made):
        rows = made[at][0]
        radius = made[at][1] = float(angles(units[rows[:1]], units[rows]).max()) if len(rows) > 1 else 0.0
        level = math.pi / 2
        while level >= max(radius, finest):
            level /= 2
        small = len(rows) <= LEAF and radius <= FINEST
        parts = _net(units, rows, level) if not small and level >= finest else []
        if len(parts) > 1:
            made[at][2:] = [len(made), len(made) + len(parts)]
            made += [[part, 0.0, 0, 0] for part in parts]
        at += 1
    return _flat(made)


def top_centres(units: np.ndarray) -> np.ndarray:
    """One centre for each leaf of the sample's tree, in tree order; a leaf that is still wide gives all its vectors."""
    tree = cover_tree(units, FINEST)
    leaves = np.flatnonzero(tree.first == tree.last)
    leaves = leaves[np.argsort(tree.lo[leaves])]
    ends = np.where(tree.radius[leaves] <= 2 * FINEST, tree.lo[leaves] + 1, tree.hi[leaves])
    return np.concatenate([units[tree.order[lo:hi]] for lo, hi in zip(tree.lo[leaves], ends)])


def _flat(made: list[list]) -> Tree:
    """Depth-first places for nodes that were made breadth-first."""
    lo, order, stack = np.zeros(len(made), dtype=np.int64), [], [0]
    place = 0
    while stack:
        node = stack.pop()
        rows, _, first, last = made[node]
        lo[node] = place
        if first == last:
            order.append(rows)
            place += len(rows)
        else:
            stack.extend(range(last - 1, first - 1, -1))
    sizes = np.array([len(m[0]) for m in made])
    radius, first, last = (np.array([m[i] for m in made]) for i in (1, 2, 3))
    return Tree(np.concatenate(order), lo, lo + sizes, radius, first, last)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest of 0 … n-1 that each of them reaches by the links (i, j)."""
    label = np.arange(n)
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label = label[label]


class Forest:
    """Links among ``n`` places, reduced to a spanning forest whenever many have come together."""

    def __init__(self, n: int):
        self.n, self.held, self.links = n, 0, []

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.links.append((i, j))
        self.held += len(i)
        if self.held > FOLD:
            label = self.labels()
            ends = np.flatnonzero(label != np.arange(self.n))
            self.links, self.held = [(ends, label[ends])], 0

    def labels(self) -> np.ndarray:
        if not self.links:
            return np.arange(self.n)
        i, j = (np.concatenate(side) for side in zip(*self.links))
        return spanning(i, j, self.n)


class Subtree:
    """A stripe's tree with its vectors in tree order: as given, as unit rows, and how many copies each stands for.
    ``begin`` is the place of the first among all vectors of the tile."""

    def __init__(self, tree: Tree, raw: np.ndarray, copies: np.ndarray, begin: int):
        self.tree, self.raw, self.copies, self.begin = tree, raw, copies, begin
        self.units = unit_rows(raw)
        self.centres = self.units[tree.lo]
        self.before = np.concatenate([[0], np.cumsum(copies)])

    def leaf(self, node: int) -> bool:
        return self.tree.first[node] == self.tree.last[node]

    def parts(self, node: int) -> np.ndarray:
        return np.arange(self.tree.first[node], self.tree.last[node])

    def span(self, node: int) -> slice:
        return slice(int(self.tree.lo[node]), int(self.tree.hi[node]))


class Counter:
    """What a traversal finds: for each place the linked copies of others, and a forest of the links."""

    def __init__(self, n: int):
        self.links, self.forest = np.zeros(n, dtype=np.int64), Forest(n)

    def whole(self, a: Subtree, x: slice, b: Subtree, y: slice) -> None:
        """Every vector of ``x`` is linked with every one of ``y``, or all of ``x`` with each other."""
        at, to = slice(a.begin + x.start, a.begin + x.stop), slice(b.begin + y.start, b.begin + y.stop)
        self.links[at] += b.before[y.stop] - b.before[y.start]
        if at == to:
            self.links[at] -= a.copies[x]
        else:
            self.links[to] += a.before[x.stop] - a.before[x.start]
        ends = np.concatenate([np.arange(at.start, at.stop), np.arange(to.start, to.stop)])
        self.forest.add(ends, np.full(len(ends), min(at.start, to.start)))

    def some(self, a: Subtree, i: np.ndarray, b: Subtree, j: np.ndarray, cosines: np.ndarray) -> None:
        """The vectors ``i`` of one stripe and ``j`` of the other are linked, one by one."""
        np.add.at(self.links, a.begin + i, b.copies[j])
        np.add.at(self.links, b.begin + j, a.copies[i])
        self.forest.add(a.begin + i, b.begin + j)


class Pairs:
    """What a traversal finds, pair by pair."""

    def __init__(self):
        self.found: list[tuple] = []

    def whole(self, a: Subtree, x: slice, b: Subtree, y: slice) -> None:
        products = a.units[x] @ b.units[y].T
        i, j = np.nonzero(np.triu(np.ones_like(products), 1) if (a, x) == (b, y) else np.ones_like(products))
        self.some(a, i + x.start, b, j + y.start, products[i, j])

    def some(self, a: Subtree, i: np.ndarray, b: Subtree, j: np.ndarray, cosines: np.ndarray) -> None:
        self.found.append((a.begin + i, b.begin + j, cosines))


def _cosine(u: np.ndarray, v: np.ndarray) -> float:
    """From the components as given, each vector scaled by a power of two; sums without rounding on the way."""
    u, v = (np.ldexp(w.astype(np.float64), -np.frexp(np.abs(w).max())[1]) for w in (u, v))
    return math.fsum(u * v) / math.sqrt(math.fsum(u * u) * math.fsum(v * v))


def _compare(a: Subtree, i: np.ndarray, b: Subtree, j: np.ndarray, products: np.ndarray, cosine: float, found: Counter | Pairs) -> None:
    """Reports those of the pairs (i, j), with the given products of unit vectors, that reach the threshold."""
    hits = products >= cosine
    for at in np.flatnonzero(np.abs(products - cosine) < DOUBTFUL):
        hits[at] = _cosine(a.raw[i[at]], b.raw[j[at]]) >= cosine
    if hits.any():
        found.some(a, i[hits], b, j[hits], products[hits])


def _compare_leaves(a: Subtree, x: slice, b: Subtree, y: slice, cosine: float, found: Counter | Pairs) -> None:
    products = a.units[x] @ b.units[y].T
    near = products >= cosine - DOUBTFUL
    i, j = np.nonzero(np.triu(near, 1) if (a, x) == (b, y) else near)
    _compare(a, i + x.start, b, j + y.start, products[i, j], cosine, found)


def traverse(a: Subtree, b: Subtree, cosine: float, found: Counter | Pairs) -> int:
    """Reports to ``found`` all pairs of ``a`` and ``b`` (of ``a`` alone, if they are the same) with at least ``cosine``.
    Returns the number of pairs of nodes and vectors whose product that took.

    A step takes a list of nodes from each side, all children of one parent, and multiplies their centres at once.
    """
    limit, looked = math.acos(min(cosine, 1.0)), 0
    stack = [(np.array([0]), np.array([0]), a is b)]
    while stack:
        left, right, same = stack.pop()
        ra, rb = a.tree.radius[left], b.tree.radius[right]
        products = a.centres[left] @ b.centres[right].T
        looked += products.size
        close = products >= math.cos(limit + SLACK)  # so much for single vectors
        for rows, columns in ((np.flatnonzero(ra > 0), slice(None)), (slice(None), np.flatnonzero(rb > 0))):
            reach = limit + SLACK + ra[rows][:, None] + rb[columns][None, :]
            close[rows, columns] = products[rows, columns] >= np.cos(np.minimum(reach, math.pi))
        i, j = np.nonzero(np.triu(close) if same else close)
        apart, radii = np.arccos(np.clip(products[i, j], -1.0, 1.0)), ra[i] + rb[j]
        itself = (i == j) if same else np.zeros(len(i), dtype=bool)
        apart[itself] = 0.0
        open_ = apart - radii <= limit + SLACK
        i, j, apart, radii, itself = i[open_], j[open_], apart[open_], radii[open_], itself[open_]
        n, m = left[i], right[j]
        single = (a.tree.hi[n] - a.tree.lo[n] == 1) & (b.tree.hi[m] - b.tree.lo[m] == 1)
        points = single & ~itself
        _compare(a, a.tree.lo[n[points]], b, b.tree.lo[m[points]], products[i[points], j[points]], cosine, found)
        for at in np.flatnonzero(~single):
            u, v = int(n[at]), int(m[at])
            x, y = a.span(u), b.span(v)
            if apart[at] + radii[at] < limit - SLACK:
                found.whole(a, x, b, y)
            elif a.leaf(u) and b.leaf(v):
                looked += (x.stop - x.start) * (y.stop - y.start)
                _compare_leaves(a, x, b, y, cosine, found)
            elif itself[at]:
                stack.append((a.parts(u), a.parts(u), True))
            else:  # both are split, unless one is a leaf or fine enough beside the other
                ru, rv = a.tree.radius[u], b.tree.radius[v]
                one = b.leaf(v) or (not a.leaf(u) and ru > 2 * rv)
                other = a.leaf(u) or (not b.leaf(v) and rv > 2 * ru)
                stack.append((np.array([u]) if other else a.parts(u), np.array([v]) if one else b.parts(v), False))
    return looked


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy()
    if (sizes == width).all():
        return flat.reshape(-1, width)
    rows = np.zeros((len(sizes), width), dtype=flat.dtype)
    rows[np.arange(width) < sizes[:, None]] = flat
    return rows


def _usable(vector: str) -> Column:
    parts = F.col(vector)
    finite = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(parts, lambda x: x != 0), F.lit(False))


def _assigned(classes: DataFrame, centres: np.ndarray, width: int) -> DataFrame:
    kinds = pa.schema([("cell", pa.int32()), ("angle", pa.float64())])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = unit_rows(_matrix(batch["vector"], width)) if batch.num_rows else np.zeros((0, width))
            products = units @ centres.T
            cell = products.argmax(axis=1)
            angle = np.arccos(np.clip(products[np.arange(len(cell)), cell], -1.0, 1.0))
            extra = [pa.array(cell, kinds[0].type), pa.array(angle, kinds[1].type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *kinds.names])

    schema = T.StructType([*classes.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])
    return classes.mapInArrow(nearest, schema)


def _dealt(counts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First stripe and number of stripes of every cell, given in tree order: small neighbours share a stripe, a cell of
    more than ``STRIPE`` vectors has as many as it needs for itself."""
    first, parts, at, held = [], [], 0, 0
    for n in counts:
        if held and held + n > STRIPE:
            at, held = at + 1, 0
        first.append(at)
        parts.append(-(-n // STRIPE))
        held += n
        if n > STRIPE:
            at, held = at + parts[-1], 0
    return np.array(first), np.array(parts)


def _near_stripes(centres: np.ndarray, radius: np.ndarray, first: np.ndarray, parts: np.ndarray, limit: float) -> list[tuple[int, int, int, int]]:
    """Groups of stripes with a pair of cells in reach, as (first stripe, stripes) twice; at most as many as there are
    pairs of cells, which the sample bounds."""
    near = set()
    for i in range(len(centres)):
        reach = angles(centres[i : i + 1], centres[i:])[0] - radius[i] - radius[i:] <= limit + SLACK
        groups = np.unique(np.stack([first[i:], parts[i:]])[:, reach], axis=1)
        near |= {(int(first[i]), int(parts[i]), int(a), int(n)) for a, n in groups.T}
    return sorted(near)


PACKED = "stripe long, width int, vectors binary, copies array<long>, h1 array<long>, h2 array<long>, lo array<long>, hi array<long>, radius array<double>, first array<long>, last array<long>"


def _packed(rows: DataFrame, width: int) -> DataFrame:
    """One row for each stripe: its tree, and its vectors, copies and keys in tree order."""
    names = [field.split()[0] for field in PACKED.split(", ")]

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("h1", "ascending"), ("h2", "ascending")])
        raw = _matrix(table["vector"], width)
        tree = cover_tree(unit_rows(raw))
        table = table.take(pa.array(tree.order))
        columns = [table["copies"], table["h1"], table["h2"]]
        arrays = [tree.lo, tree.hi, tree.radius, tree.first, tree.last]
        cells = [table["stripe"][0], width, np.ascontiguousarray(raw[tree.order]).tobytes()]
        values = [*cells, *[c.to_pylist() for c in columns], *[v.tolist() for v in arrays]]
        kinds = [pa.int64(), pa.int32(), pa.binary(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.float64()), *[pa.list_(pa.int64())] * 2]
        return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

    return rows.groupBy("stripe").applyInArrow(build, PACKED)


def _subtrees(table: pa.Table, kind: np.dtype) -> list[tuple[int, Subtree]]:
    """The stripes of a tile, one after the other in the tile's places."""
    made, begin = [], 0
    for row in sorted(table.to_pylist(), key=lambda r: r["stripe"]):
        raw = np.frombuffer(row["vectors"], dtype=kind).reshape(-1, row["width"])
        arrays = [np.array(row[c]) for c in ("lo", "hi", "radius", "first", "last")]
        made.append((row["stripe"], Subtree(Tree(np.arange(len(raw)), *arrays), raw, np.array(row["copies"], dtype=np.int64), begin)))
        begin += len(raw)
    return made


def _traverse_tile(table: pa.Table, key: tuple, kind: np.dtype, side: int, cosine: float, found: Counter | Pairs) -> np.ndarray:
    """Traverses the pairs of stripes of the tile ``key``; returns the address of each of the tile's places."""
    subtrees, (i, j) = _subtrees(table, kind), (k.as_py() for k in key)
    for at, (s, a) in enumerate(subtrees):
        for t, b in subtrees[at:]:
            if (s // side, t // side) == (i, j):
                traverse(a, b, cosine, found)
    return np.concatenate([stripe * SLOT + np.arange(len(tree.raw)) for stripe, tree in subtrees])


class _Join:
    """The stored stages of one join: classes of equal vectors, their stripes, and the tiles to be traversed."""

    def __init__(self, vectors: DataFrame, cosine: float, id: str, vector: str):
        self.cosine, self.limit = cosine, math.acos(cosine)
        given = vectors.schema[vector].dataType.elementType
        self.kind = np.dtype(np.float32 if isinstance(given, T.FloatType) else np.float64)
        held = F.col(f"`{vector}`").cast("array<float>" if self.kind == np.float32 else "array<double>")
        self.rows = vectors.select(F.col(f"`{id}`").alias("id"), held.alias("vector"))
        self.rows = self.rows.withColumns({"usable": _usable("vector")} | dict(zip(("h1", "h2"), hash_pair(F.col("vector")))))
        classes = self.rows.filter("usable").groupBy("h1", "h2")
        self.classes = written(classes.agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("vector").alias("vector")))
        self.width = self.classes.agg(F.max(F.size("vector"))).first()[0]
        self.empty = self.width is None
        if self.empty:
            return
        spark = vectors.sparkSession
        sample = self.classes.orderBy("h1", "h2").limit(SAMPLE).select("vector").toArrow()
        centres = top_centres(unit_rows(_matrix(sample["vector"], self.width)))
        assigned = written(_assigned(self.classes.drop("least"), centres, self.width))
        cells = assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far")).orderBy("cell").collect()
        first, parts = _dealt([c["n"] for c in cells])
        rows = [(c["cell"], int(a), int(n)) for c, a, n in zip(cells, first, parts)]
        striped = assigned.join(F.broadcast(spark.createDataFrame(rows, "cell int, first long, parts long")), "cell")
        striped = striped.withColumn("stripe", F.col("first") + F.pmod("h1", "parts"))
        self.packed = written(_packed(striped.select("stripe", "cell", "h1", "h2", "copies", "vector"), self.width))
        used = centres[[c["cell"] for c in cells]]
        near = _near_stripes(used, np.array([c["far"] for c in cells]), first, parts, self.limit)
        self.near = spark.createDataFrame(near, "a long, na long, b long, nb long")
        self.side = max(1, min(TILE_BYTES // (STRIPE * self.width * 8), int(first[-1] + parts[-1]) // LEAST_TILES))

    def tiles(self) -> DataFrame:
        """The stripes of every tile that holds a pair of stripes in reach."""
        pairs = self.near.select("a", F.explode(F.sequence("a", F.expr("a + na - 1"))).alias("s"), "b", "nb")
        pairs = pairs.select("s", F.explode(F.sequence("b", F.expr("b + nb - 1"))).alias("t")).filter("s <= t")
        both = pairs.select(F.expr(f"s div {self.side}").alias("i"), F.expr(f"t div {self.side}").alias("j"), "s", "t")
        wanted = both.select("i", "j", F.explode(F.array("s", "t")).alias("stripe")).distinct()
        n = max(1, both.select("i", "j").distinct().count())
        return wanted.join(self.packed.drop("h1", "h2"), "stripe").repartition(n, "i", "j").groupBy("i", "j")

    def places(self) -> DataFrame:
        """``(address, h1, h2, least, copies)`` of every class."""
        spots = self.packed.select("stripe", F.posexplode(F.arrays_zip("h1", "h2")).alias("place", "key"))
        spots = spots.select((F.col("stripe") * SLOT + F.col("place")).alias("address"), "key.h1", "key.h2")
        return spots.join(self.classes.select("h1", "h2", "least", "copies"), ["h1", "h2"])


def similar_pairs(vectors: DataFrame, cosine: float = 0.9, *, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """All pairs ``(a, b, cosine)`` of different vectors with at least ``cosine``, named by the smallest id of the rows
    that hold them, and the membership ``(id, least)`` of all rows with a usable vector. See ``near_groups``."""
    join = _Join(vectors, cosine, id, vector)
    kind = join.rows.schema["id"].dataType.simpleString()
    members = join.rows.filter("usable").select("id", "h1", "h2")
    members = skew_join(members, join.classes.select("h1", "h2", "least"), ["h1", "h2"]).select("id", "least")
    if join.empty:
        return vectors.sparkSession.createDataFrame([], f"a {kind}, b {kind}, cosine double"), members
    dtype, side = join.kind, join.side

    def pairs(key: tuple, table: pa.Table) -> pa.Table:
        found = Pairs()
        address = _traverse_tile(table, key, dtype, side, cosine, found)
        i, j, cosines = (np.concatenate([f[n] for f in found.found] or [np.zeros(0, dtype=t)]) for n, t in enumerate((int, int, float)))
        return pa.table({"x": address[i], "y": address[j], "cosine": cosines})

    made = join.tiles().applyInArrow(pairs, "x long, y long, cosine double")
    names = written(join.places().select("address", "least"))
    made = made.join(names.toDF("x", "a"), "x").join(names.toDF("y", "b"), "y")
    return made.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine"), members


def near_groups(vectors: DataFrame, cosine: float = 0.9, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every row of ``vectors`` as ``(id, n_links, component_id)``: how many other rows it is linked with directly, by a
    cosine of at least ``cosine`` (above 0) in double precision, and the smallest id it reaches by links.

    Rows of equal vectors are linked and compared as one. Vectors that are null, empty, zero, or hold a null or no finite
    number, link with nothing and are their own component. Shorter vectors are taken to end in zeros. Rows may repeat
    ids; a row without an id counts as a link and takes part in its group, whose id is the smallest of the others.
    """
    join = _Join(vectors, cosine, id, vector)
    alone = F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")
    if join.empty:
        return join.rows.select("id", *alone)
    dtype, side = join.kind, join.side

    def count(key: tuple, table: pa.Table) -> pa.Table:
        found = Counter(pc.sum(pc.list_value_length(table["copies"])).as_py())
        address = _traverse_tile(table, key, dtype, side, cosine, found)
        label, links = found.forest.labels(), found.links
        told = np.flatnonzero((links > 0) | (label != np.arange(len(label))))
        return pa.table({"address": address[told], "links": links[told], "label": address[label[told]]})

    found = written(join.tiles().applyInArrow(count, "address long, links long, label long"))
    links = found.groupBy("address").agg(F.sum("links").alias("links"))
    labels = components(found.filter("address <> label").select(F.col("address").alias("a"), F.col("label").alias("b")))
    known = join.places().join(links, "address", "left").join(labels.withColumnRenamed("node", "address"), "address", "left")
    known = written(known.select("h1", "h2", "least", "copies", "links", F.coalesce("label", "address").alias("label")))
    smallest = known.groupBy("label").agg(F.min("least").alias("component_id"))
    known = skew_join(known, smallest, ["label"])
    n_links = (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    usable = skew_join(join.rows.filter("usable").drop("vector"), known.select("h1", "h2", n_links, "component_id"), ["h1", "h2"])
    return usable.select("id", "n_links", "component_id").unionByName(join.rows.filter("not usable").select("id", *alone))
