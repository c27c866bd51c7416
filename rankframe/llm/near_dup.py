"""Near-duplicate groups by a chosen-path set similarity join.

Equal shingle sets are one class. Every class walks down several independent trees: at a node it takes the branches
named by its minwise tokens of that tree and depth, so two similar sets share a branch with the probability of their
similarity at each of the node's functions. Nodes of at most ``leaf`` classes are compared as they are, larger ones
branch again; what is still large at the last depth is a dense node. Comparisons come in two rounds. In the first,
each node's classes meet its smallest class only, which joins groups of copies with a number of pairs linear in their
size. In the second, the classes of a node meet those of other components, all of them, in cells of two blocks. Byte
sketches sort out classes without a possible partner in their cell; the others come together once more with their full
sets, and a cell counts all its intersections at once. No pair of a cell becomes a row unless it is a link that joins
two components. In both rounds every link is confirmed on full sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import written
from rankframe.llm.columns import hash_pair, packed, strip_spaces
from rankframe.llm.components import components
from rankframe.llm.cover_tree import spanning
from rankframe.llm.shingles import MinHashes, WordHashes, digest, estimated, shingle_set, sketch, stacked
from rankframe.llm.skew import skew_join

PERCENT = 85
DEPTH, BRANCHES, LEAF = 3, 2, 64
MISSED = 2.1e-5
"""Two sets of similarity 0.85 miss each other in all nodes of the first depth with probability 0.15⁸, about 3e-7; where
their shared nodes are large and branch again, at each further depth with 0.15² more in a tree. ``MISSED`` bounds the
probability for nodes that are large at every depth, at the threshold itself."""

SKETCH = 96
DEVIATIONS = 6
"""A pair whose estimate is more than so many standard deviations below the threshold is dropped."""

BLOCK = 512
COMMON, COLUMNS = 32, 4096
"""A shingle in more sets of a cell than ``COMMON`` is counted by a product of matrices, ``COLUMNS`` shingles at once."""
BUCKETS = 1 << 20
MADE = ("n_shingles", "component_id", "kept")


def trees_for(percent: int) -> int:
    """Trees that keep the probability of a miss under ``MISSED``: 4 at 85 %, 5 at 80 %; as many as the sketch has values for."""
    in_tree = 1 - (1 - (1 - percent / 100) ** BRANCHES) ** DEPTH
    most = SKETCH // (DEPTH * BRANCHES)
    return next((n for n in range(4, most) if in_tree**n <= MISSED), most)


def margin(percent: int) -> float:
    """``DEVIATIONS`` of an estimate at the threshold, rounded up: 0.22 at 85 %, 0.25 at 80 %."""
    return math.ceil(100 * DEVIATIONS * math.sqrt(percent / 100 * (1 - percent / 100) / SKETCH)) / 100


def sketched(df: DataFrame, text: str, row_id: str, trees: int) -> DataFrame:
    """(doc_id, _id, t1, t2, cid, n, tokens, sketch) of every row: cid names the shingle set, null if it is empty."""
    t1, t2 = hash_pair(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    source = df.select(F.col(f"`{row_id}`").alias("doc_id"), F.monotonically_increasing_id().alias("_id"), t1.alias("t1"), t2.alias("t2"), F.col(f"`{text}`").alias("_text"))
    n_tokens = trees * DEPTH * BRANCHES

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minwise = WordHashes(), MinHashes(SKETCH)
        for part in parts:
            cids, sizes, tokens, sketches = [], [], [], []
            for value in part.column(part.num_columns - 1):
                values = shingle_set(value.as_py(), hashes)
                low = minwise(values) if len(values) else None
                sizes.append(len(values))
                cids.append(None if low is None else digest(values))
                tokens.append(None if low is None else low[:n_tokens].view(np.int64))
                sketches.append(None if low is None else sketch(low))
            made = [pa.array(cids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(tokens, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], schema.fieldNames())

    made = [("cid", T.BinaryType()), ("n", T.LongType()), ("tokens", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())]
    schema = T.StructType([*[source.schema[c] for c in source.columns[:-1]], *[T.StructField(*m) for m in made]])
    return source.mapInArrow(batches, schema)


def nodes(classes: DataFrame, trees: int, leaf: int = LEAF) -> DataFrame:
    """(node, cid) of all nodes with two classes or more: leaves of every depth and dense nodes of the last."""

    def branch(rows: DataFrame, depth: int) -> DataFrame:
        """``rows`` (node, tree, cid, tokens) to the nodes below."""
        picks = F.transform(
            F.sequence(F.lit(0), F.lit(BRANCHES - 1)),
            lambda b: F.xxhash64("node", b, F.get("tokens", (F.col("tree") * DEPTH + depth) * BRANCHES + b)),
        )
        return rows.select(F.explode(F.array_distinct(picks)).alias("node"), "tree", "cid")

    roots = classes.select("cid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")).withColumn("node", F.col("tree").cast("long"))
    frontier, done = branch(roots, 0), None
    for depth in range(DEPTH):
        sizes = frontier.groupBy("node").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        shared = written(skew_join(frontier, sizes, ["node"]))
        last = depth == DEPTH - 1
        ready = shared.select("node", "cid") if last else shared.filter(F.col("size") <= leaf).select("node", "cid")
        done = ready if done is None else done.unionByName(ready)
        if not last:
            large = shared.filter(F.col("size") > leaf).select("node", "tree", "cid")
            frontier = branch(large.join(classes.select("cid", "tokens"), "cid"), depth + 1)
    return done


def _may_match(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    sized = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sized & (estimated(a, b) >= percent / 100 - margin(percent))


def star_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each node's smallest class a with its others, as far as the sketches let them pass.

    ``members`` has (node, cid, n, sketch)."""
    smallest = members.groupBy("node").agg(F.min(F.struct("cid", "n", "sketch")).alias("p"))
    star = skew_join(members, smallest, ["node"]).filter(F.col("p.cid") != F.col("cid"))
    rows = star.select(F.col("p.cid").alias("a"), F.col("cid").alias("b"), F.col("p.n").alias("n_a"), "n", F.col("p.sketch").alias("s_a"), "sketch")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                s_a, s_b = (stacked(part.column(c).to_pylist(), SKETCH) for c in ("s_a", "sketch"))
                n_a, n_b = (part.column(c).to_numpy() for c in ("n_a", "n"))
                yield part.select(["a", "b"]).filter(pa.array(_may_match(s_a, s_b, n_a, n_b, percent)))

    return rows.mapInArrow(batches, "a binary, b binary").distinct()


def cells(members: DataFrame) -> DataFrame:
    """(node, i, j, block, cid, label, n, sketch): the classes of every node with several components, dealt to cells.

    ``members`` has (node, cid, label, n, sketch). In a node the classes of its most frequent component need not meet
    one another: they lie in blocks of ``BLOCK``, the others in blocks of their own, and each block of others meets
    every block. A block pair is one group of at most twice ``BLOCK`` rows.
    """
    by_label = members.groupBy("node", "label").agg(F.count(F.lit(1)).alias("m"))
    sizes = by_label.groupBy("node").agg(
        F.sum("m").alias("size"), F.max(F.struct("m", "label")).alias("main"), F.count(F.lit(1)).alias("labels")
    ).filter((F.col("labels") > 1) & (F.col("size") > 2)).select(
        "node",
        F.col("main.label").alias("main"),
        F.ceil(F.col("main.m") / BLOCK).cast("int").alias("main_blocks"),
        F.ceil((F.col("size") - F.col("main.m")) / BLOCK).cast("int").alias("other_blocks"),
    )
    rows = skew_join(members, sizes, ["node"])
    is_main = F.col("label") == F.col("main")
    block = F.pmod(F.xxhash64("cid"), F.when(is_main, F.col("main_blocks")).otherwise(F.col("other_blocks"))).cast("int")
    others = F.sequence(F.lit(0), F.col("other_blocks") - 1)
    mains = F.sequence(-F.col("main_blocks"), F.lit(-1))
    rows = rows.withColumn("block", F.when(is_main, -block - 1).otherwise(block))
    meets = F.when(is_main, F.transform(others, lambda o: F.struct(o.alias("i"), F.col("block").alias("j")))).otherwise(
        F.concat(
            F.transform(mains, lambda m: F.struct(F.col("block").alias("i"), m.alias("j"))),
            F.transform(others, lambda o: F.struct(F.greatest(o, "block").alias("i"), F.least(o, "block").alias("j"))),
        )
    )
    return rows.select("node", "cid", "label", "n", "sketch", "block", F.explode(meets).alias("at")).select("*", "at.*").drop("at")


def by_cell(rows: DataFrame, compare: Callable[[pa.Table, np.ndarray, np.ndarray, bool], pa.RecordBatch], schema: str) -> DataFrame:
    """``compare`` of each cell: its rows, those of its first and of its second block, and whether the two are one."""
    keys = ["node", "i", "j"]

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        cell = pa.Table.from_batches(parts).combine_chunks()
        i, j, block = (cell.column(c).to_numpy()[x] for c, x in (("i", slice(1)), ("j", slice(1)), ("block", slice(None))))
        return compare(cell, np.flatnonzero(block == i), np.flatnonzero(block == j), bool(i[0] == j[0]))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_cell: list[pa.RecordBatch] = []
        open_key = None
        for part in parts:
            if not part.num_rows:
                continue
            of = np.stack([part.column(k).to_numpy() for k in keys], axis=1)
            edges = [0, *(np.flatnonzero((of[1:] != of[:-1]).any(axis=1)) + 1).tolist(), part.num_rows]
            for start, end in zip(edges, edges[1:]):
                key = tuple(of[start])
                if open_cell and key != open_key:
                    yield whole(open_cell)
                    open_cell = []
                open_key = key
                open_cell.append(part.slice(start, end - start))
        if open_cell:
            yield whole(open_cell)

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def _codes(labels: list[bytes]) -> np.ndarray:
    return np.unique(np.array(labels, dtype=object), return_inverse=True)[1]


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of every set of ``left`` with every one of ``right``, all at once.

    Shingles of many sets are columns of a matrix of zeros and ones, multiplied in pieces; of the others, each pair of
    sets that holds one is counted."""
    counts = np.zeros((len(left), len(right)), dtype=np.float32)
    row = np.concatenate([np.full(len(v), at) for at, v in enumerate(sets)])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = {}
    for name, rows in (("left", left), ("right", right)):
        place[name] = np.full(len(sets), -1)
        place[name][rows] = np.arange(len(rows))
    common = np.flatnonzero(often > COMMON)
    number = np.full(len(often), -1)
    number[common] = np.arange(len(common))
    for start in range(0, len(common), COLUMNS):
        held = (number[column] >= start) & (number[column] < start + COLUMNS)
        piece = np.zeros((len(sets), min(COLUMNS, len(common) - start)), dtype=np.float32)
        piece[row[held], number[column[held]] - start] = 1
        counts += piece[left] @ piece[right].T
    rare = (often[column] > 1) & (often[column] <= COMMON)
    row, column = row[rare], column[rare]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for shift in range(1, COMMON):  # the partners of a row are at most so many places further on
        same = column[shift:] == column[:-shift]
        if not same.any():
            break
        x, y = row[:-shift][same], row[shift:][same]
        for p, q in ((x, y), (y, x)):
            there = (place["left"][p] >= 0) & (place["right"][q] >= 0)
            np.add.at(counts, (place["left"][p[there]], place["right"][q[there]]), 1)
    return counts.astype(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers of links (a, b) that join all that the links join, fewer than two for each end: every component takes the
    first link that leaves it, until none does."""
    kept = np.zeros(0, dtype=np.int64)
    if not len(a):
        return kept
    n = int(max(a.max(), b.max())) + 1
    label = np.arange(n)
    while (left := np.flatnonzero(label[a] != label[b])).size:
        ends = np.concatenate([label[a[left]], label[b[left]]])
        _, first = np.unique(ends, return_index=True)
        kept = np.unique(np.concatenate([kept, left[first % len(left)]]))
        label = spanning(a[kept], b[kept], n)
    return kept


def cross_links(members: DataFrame, reps: DataFrame, df: DataFrame, text: str, row_id: str, percent: int) -> DataFrame:
    """Confirmed links (a, b) of classes of one node but different components: in each cell as many as it takes to join
    the components that its links join."""

    def partnered(cell: pa.Table, left: np.ndarray, right: np.ndarray, one: bool) -> pa.RecordBatch:
        """The classes whose sketch allows a link with another component's in this cell."""
        sketches, n = stacked(cell.column("sketch").to_pylist(), SKETCH), cell.column("n").to_numpy()
        label, kept = _codes(cell.column("label").to_pylist()), np.zeros(cell.num_rows, dtype=bool)
        for x in left:
            passed = right[_may_match(sketches[x], sketches[right], n[x], n[right], percent)]
            passed = passed[label[passed] != label[x]]
            kept[passed] = True
            kept[x] |= len(passed) > 0
        table = cell.select(["node", "i", "j", "block", "cid", "label"]).filter(pa.array(kept)).combine_chunks()
        return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], table.schema)

    near = written(by_cell(cells(members), partnered, "node long, i int, j int, block int, cid binary, label binary"))
    sets = shingle_sets(near.select("cid").distinct(), reps, df, text, row_id)

    def linked(cell: pa.Table, left: np.ndarray, right: np.ndarray, one: bool) -> pa.RecordBatch:
        held = [np.frombuffer(v.as_buffer(), np.uint64) for v in cell.column("shingles").combine_chunks()]
        cids, label = cell.column("cid").to_pylist(), _codes(cell.column("label").to_pylist())
        n = np.array([len(v) for v in held])
        common = intersections(held, left, right)
        both = n[left][:, None] + n[right][None, :] - common
        x, y = np.nonzero((100 * common >= percent * both) & (label[left][:, None] != label[right][None, :]))
        x, y = left[x], right[y]
        joining = forest(label[x], label[y])
        ends = [(min(cids[p], cids[q]), max(cids[p], cids[q])) for p, q in zip(x[joining], y[joining])]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])

    return by_cell(skew_join(near, sets, ["cid"]), linked, "a binary, b binary").distinct()


def shingle_sets(wanted: DataFrame, reps: DataFrame, df: DataFrame, text: str, row_id: str) -> DataFrame:
    """(cid, shingles) of the classes ``wanted`` (cid), stored.

    ``reps`` has (cid, doc_id, t1, t2): a row of ``df`` for each class. Texts
    are sorted out in the scan by a broadcast of the buckets of their hash that are wanted, at most ``BUCKETS`` of
    them, and the rest meet the wanted rows exactly.
    """
    places = written(wanted.join(reps, "cid")).select("cid", F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    t1, t2 = hash_pair(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    texts = df.select(F.col(f"`{row_id}`").alias("_own"), t1.alias("t1"), t2.alias("t2"), F.col(f"`{text}`").alias("_text"))
    bucket = lambda c: F.pmod(F.col(c), F.lit(BUCKETS))
    buckets = places.select(bucket("_t1").alias("_bucket")).distinct()
    texts = texts.withColumn("_bucket", bucket("t1")).join(F.broadcast(buckets), "_bucket", "left_semi")
    on = (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & F.col("_own").eqNullSafe(F.col("_doc"))
    found = texts.join(places, on).select("cid", "_text")

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for part in parts:
            sets = [shingle_set(t.as_py(), hashes).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cid", "shingles"])

    return written(found.mapInArrow(build, "cid binary, shingles binary").dropDuplicates(["cid"]))


def confirmed(pairs: DataFrame, reps: DataFrame, df: DataFrame, text: str, row_id: str, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) whose full shingle sets have a Jaccard similarity of ``percent`` or more. Only sets of classes
    in a pair are built."""
    wanted = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    sets = shingle_sets(wanted, reps, df, text, row_id)
    right = pairs.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("s_b")), "b")
    both = skew_join(right, sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s_a")), ["a"])

    def check(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keep = []
            for x, y in zip(part.column(2), part.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "s_a", "s_b").mapInArrow(check, "a binary, b binary")


def groups(df: DataFrame, text: str = "text", row_id: str = "doc_id", percent: int = PERCENT, leaf: int = LEAF) -> DataFrame:
    """One row for each row of ``df``: (doc_id, t1, t2, n_shingles, component_id, kept); t1 and t2 hash its text.

    Rows link whose sets of five-word shingles have a Jaccard similarity of ``percent`` per hundred or more.
    ``component_id`` is the smallest id that links lead to, ``kept`` marks one row of each component, the one with
    that id. Ids that are null come after all others; of rows that repeat an id one is kept. A row without words,
    or of a null text, links with nothing and is kept.
    """
    trees = trees_for(percent)
    rows = written(sketched(df, text, row_id, trees))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_id", "t1", "t2")
    classes = written(
        rows.filter(F.col("cid").isNotNull())
        .groupBy("cid")
        .agg(F.min(rank).alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("sketch").alias("sketch"))
    )
    reps = classes.select("cid", "rep.doc_id", "rep.t1", "rep.t2")
    members = written(nodes(classes, trees, leaf).join(classes.select("cid", "n", "sketch"), "cid"))
    links = written(confirmed(written(star_pairs(members, percent)), reps, df, text, row_id, percent))
    labels = components(links)
    named = members.join(labels.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    more = written(cross_links(named, reps, df, text, row_id, percent))

    own = labels.withColumnRenamed("node", "cid")
    joined = more
    for end in ("a", "b"):
        joined = skew_join(joined, own.select(F.col("cid").alias(end), F.col("label").alias(f"l_{end}")), [end], "left")
    between = joined.select(F.coalesce("l_a", "a").alias("a"), F.coalesce("l_b", "b").alias("b")).distinct()
    merged = components(between).select(F.col("node").alias("first"), F.col("label").alias("final"))

    labelled = classes.select("cid", "rep").join(own, "cid", "left").withColumn("first", F.coalesce("label", "cid")).drop("label")
    labelled = skew_join(labelled, merged, ["first"], "left").select("cid", "rep", F.coalesce("final", "first").alias("label"))
    best = labelled.groupBy("label").agg(F.min("rep").alias("best"))
    of_class = skew_join(labelled, best, ["label"]).select("cid", "best")
    whole = skew_join(rows.select("doc_id", "_id", "t1", "t2", "cid", "n"), of_class, ["cid"], "left")
    return whole.select(
        "doc_id",
        "t1",
        "t2",
        F.col("n").alias("n_shingles"),
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("best._id") == F.col("_id"))).alias("kept"),
    )


def without_near_duplicates(df: DataFrame, text: str = "text", row_id: str = "doc_id", **options) -> DataFrame:
    """One row of ``df`` for each group of near duplicates, with its columns as they are. Rows without words stay."""
    kept = groups(df, text, row_id, **options).filter("kept and n_shingles > 0")
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).distinct()
    t1, t2 = hash_pair(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    wordless = strip_spaces(F.coalesce(F.col(f"`{text}`"), F.lit(""))) == ""
    rows = df.select(packed(df).alias("_row"), F.col(f"`{row_id}`").alias("_own"), t1.alias("t1"), t2.alias("t2"), wordless.alias("_wordless"))
    same = Window.partitionBy("t1", "t2", "_own").orderBy(F.lit(0))
    on = (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & F.col("_own").eqNullSafe(F.col("_doc"))
    one = rows.filter(~F.col("_wordless")).withColumn("_n", F.row_number().over(same)).filter("_n = 1").join(kept, on, "left_semi")
    return one.select("_row.*").unionByName(rows.filter("_wordless").select("_row.*"))
