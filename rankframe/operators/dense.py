"""Exact top-k by cosine similarity over stored vectors.

The work is a product of two matrices, which Spark cuts into blocks: a task multiplies its documents with
a block of queries and keeps the k best per query, so no (query, document) pair is ever a row unless it may
still reach the result. Runs of ``STEP`` documents have a pivot, their mean direction, and an angle that covers them:
by the triangle inequality none of them is closer to a query than the query's angle to the pivot less that angle, and
a query whose k-th best is closer than this leaves them out. ``by_pivot`` lays vectors out so that such runs are narrow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rankframe.functions.ranking import shuffle_partitions, top_k, written
from rankframe.functions.sizing import BROADCAST_BYTES
from rankframe.functions.text import normalize_query

BLOCK_ROWS = 16_384
BLOCK_QUERIES = 512
STEP = 1024
SLACK = 1e-7
"""Bounds count as out of reach only by more than this cosine."""
PIVOTS = 256
FOUND_BYTES = 32
"""Size of one kept (score, document) entry."""
CELL_BYTES = 256 * 1024 * 1024
SCALE = 10**12
"""Similarities are kept to twelve decimals: a block's shape may change what lies beyond them."""

QueryGroups = dict[tuple, list[tuple[list, np.ndarray]]]
"""Per value of the ``by`` columns: chunks of query ids and their unit vectors."""


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors as unit rows; a vector without length stays zero, so all its similarities are 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("a stored vector is null")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = column.value_lengths().to_numpy()
    if (lengths != lengths[0]).any():
        raise ValueError("stored vectors differ in length")
    if not np.isfinite(flat).all():
        raise ValueError("a stored vector has a value that is no finite number")
    rows = flat.reshape(len(column), int(lengths[0]))
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 0)


def _order_codes(values: np.ndarray, descending: bool) -> np.ndarray:
    """0, 1, 2… in the order in which ties are broken; equal values share a code."""
    _, codes = np.unique(values, return_inverse=True)
    return codes.max(initial=0) - codes if descending else codes


def _bounds(queries: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each query a cosine that none of ``docs`` exceeds. A vector without length has the cosine 0 with all."""
    pivot = docs.mean(axis=0)
    size = np.sqrt(pivot @ pivot)
    if size == 0:
        return np.ones(len(queries))
    pivot /= size
    to_docs = np.arccos(np.clip(docs @ pivot, -1.0, 1.0)).max()
    to_queries = np.arccos(np.clip(queries @ pivot, -1.0, 1.0))
    bound = np.cos(np.maximum(to_queries - to_docs, 0.0))
    return bound if (docs != 0).any(axis=1).all() else np.maximum(bound, 0.0)


class _Best:
    """The k best documents of each query among the blocks seen so far."""

    def __init__(self, n_queries: int, k: int, descending: bool):
        self.k, self.descending, self.n_queries = k, descending, n_queries
        self.query = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.tie = self.docid = None
        self.floor = np.full(n_queries, np.iinfo(np.int64).min)

    def add(self, queries: np.ndarray, docs: np.ndarray, docid: np.ndarray, tie: np.ndarray) -> int:
        """Takes in a block, run by run; returns the number of (query, run) products that the bounds spared."""
        spared = 0
        for start in range(0, len(docid), STEP):
            run = slice(start, start + STEP)
            open_ = np.flatnonzero(_bounds(queries, docs[run]) + SLACK >= self.floor / SCALE)
            spared += self.n_queries - len(open_)
            if len(open_):
                self._add(open_, queries[open_], docs[run], docid[run], tie[run])
        return spared

    def _add(self, asked: np.ndarray, queries: np.ndarray, docs: np.ndarray, docid: np.ndarray, tie: np.ndarray) -> None:
        n, keep = len(docid), min(self.k, len(docid))
        scores = np.rint((queries @ docs.T) * SCALE).astype(np.int64)
        place = np.argsort(np.argsort(_order_codes(tie, self.descending), kind="stable"), kind="stable")
        if keep < n:
            cells = np.argpartition(scores * n + (n - 1 - place), n - keep, axis=1)[:, n - keep :]
        else:
            cells = np.broadcast_to(np.arange(n), scores.shape)
        kept = np.take_along_axis(scores, cells, axis=1)
        query, cell = np.nonzero(kept >= self.floor[asked][:, None])
        self._merge(asked[query], kept[query, cell], docid[cells[query, cell]], tie[cells[query, cell]])

    def _merge(self, query: np.ndarray, score: np.ndarray, docid: np.ndarray, tie: np.ndarray) -> None:
        if self.docid is not None:
            query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
            docid, tie = np.concatenate([self.docid, docid]), np.concatenate([self.tie, tie])
        order = np.lexsort((_order_codes(tie, self.descending), -score, query))
        query = query[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[nth < self.k]
        self.query, self.score, self.docid, self.tie = query[nth < self.k], score[order], docid[order], tie[order]
        full = nth[nth < self.k] == self.k - 1
        self.floor[self.query[full]] = self.score[full]


def by_pivot(embeddings: DataFrame, pivots: int = PIVOTS) -> DataFrame:
    """``embeddings`` with like vectors next to each other, to be stored or searched: dealt out in the order of the
    nearest of ``pivots`` vectors, which are picked by a hash of their ids. A search is exact over any layout."""
    picked = embeddings.select("docid", "embedding").orderBy(F.xxhash64(F.col("docid").cast("string")), "docid").limit(pivots)
    centres = _matrix(picked.select("embedding").toArrow()["embedding"])
    schema = T.StructType([*embeddings.schema.fields, T.StructField("_cell", T.IntegerType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch["embedding"])
            cell = (rows @ centres.T).argmax(axis=1) if len(rows) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], [*batch.schema.names, "_cell"])

    dealt = embeddings.mapInArrow(assign, schema).repartitionByRange(shuffle_partitions(embeddings), "_cell", "docid")
    return dealt.sortWithinPartitions("_cell", "docid").drop("_cell")


def _values(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _search_blocks(
    blocks: Iterator[pa.Table],
    query_groups: QueryGroups,
    by: Sequence[str],
    k: int,
    tie: str,
    tie_desc: bool,
    schema: pa.Schema,
) -> Iterator[pa.RecordBatch]:
    found = {
        key: [(qids, matrix, _Best(len(qids), k, tie_desc)) for qids, matrix in chunks]
        for key, chunks in query_groups.items()
    }
    for block in blocks:
        matrix, docid, ties = _matrix(block["embedding"]), _values(block["docid"]), _values(block[tie])
        if by:
            groups = block.select(list(by)).to_pandas().groupby(list(by), sort=False, dropna=False).indices
            parts = [(key if isinstance(key, tuple) else (key,), rows) for key, rows in groups.items()]
        else:
            parts = [((), np.arange(len(docid)))]
        for key, rows in parts:
            for _, queries, best in found.get(key, ()):
                best.add(queries, matrix[rows], docid[rows], ties[rows])
    for key, qids, best in [(key, qids, best) for key, kept in found.items() for qids, _, best in kept]:
        if best.docid is None:
            continue
        columns = {c: pa.array([key[i]] * len(best.query), schema.field(c).type) for i, c in enumerate(by)}
        columns["qid"] = pa.array([qids[i] for i in best.query], schema.field("qid").type)
        columns["docid"] = pa.array(best.docid.tolist(), schema.field("docid").type)
        columns["score"] = pa.array(best.score / SCALE, pa.float64())
        if tie != "docid":
            columns[tie] = pa.array(best.tie.tolist(), schema.field(tie).type)
        yield from pa.table([columns[f.name] for f in schema], schema=schema).to_batches()


def _grouped_queries(table: pa.Table, by: Sequence[str]) -> QueryGroups:
    matrix, qids = _matrix(table["embedding"]), table["qid"].to_pylist()
    keys = list(zip(*[table[c].to_pylist() for c in by])) if by else [()] * len(qids)
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(keys):
        rows.setdefault(key, []).append(i)
    chunks = {key: [at[i : i + BLOCK_QUERIES] for i in range(0, len(at), BLOCK_QUERIES)] for key, at in rows.items()}
    return {key: [([qids[i] for i in at], matrix[at]) for at in parts] for key, parts in chunks.items()}


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        while rows + batch.num_rows >= size:
            take = size - rows
            yield pa.Table.from_batches([*held, batch.slice(0, take)])
            held, rows, batch = [], 0, batch.slice(take)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def dense_search(
    queries: DataFrame,
    embeddings: DataFrame,
    k: int = 100,
    *,
    encoder: Callable[[Column], Column] | None = None,
    fmt: Callable[[Column], Column] = normalize_query,
    by: Sequence[str] = (),
    tie: str = "docid",
    tie_desc: bool = False,
    block: int = BLOCK_ROWS,
    query_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The k documents most similar to each query, exactly, as ``(…by, qid, docid, score, rank)``.

    ``queries`` carries ``embedding``, or ``query`` text for ``encoder`` after ``fmt``. Columns in ``by``
    (a snapshot) must agree between query and document. Equal scores are ordered by ``tie``, ascending
    unless ``tie_desc``. Queries whose vectors and k-best lists measure up to ``query_bytes`` go to every
    task and the documents are scanned without a shuffle; more of them are cut into stripes that meet stripes of
    documents in a grid.
    """
    if encoder is not None:  # stored, so that the model runs once for each query
        queries = written(queries.withColumn("embedding", encoder(fmt(F.col("query")))))
    by = list(by)
    asked = queries.select(*by, "qid", "embedding")
    extra = [] if tie == "docid" else [tie]
    stored = embeddings.select(*by, "docid", *extra, "embedding")
    fields = [
        *[asked.schema[c] for c in by],
        asked.schema["qid"],
        stored.schema["docid"],
        *[stored.schema[c] for c in extra],
        T.StructField("score", T.DoubleType()),
    ]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields])
    out = to_arrow_schema(schema)

    size = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    needed = (size["n"] or 0) * ((size["dim"] or 0) * 8 + k * FOUND_BYTES)
    if needed <= query_bytes:
        table = asked.toArrow()
        grouped = _grouped_queries(table, by)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _search_blocks(_blocks(batches, block), grouped, by, k, tie, tie_desc, out)

        found = stored.mapInArrow(scan, schema)
        # with ``by`` the vectors come out of a join as a rule, and asking for its tasks would run it
        tasks = None if by else stored.rdd.getNumPartitions()
    else:
        stripes = -(-needed // query_bytes)
        cells = max(1, -(-stored.count() * size["dim"] * 8 // CELL_BYTES))
        left = asked.withColumn("_q", F.pmod(F.xxhash64("qid"), F.lit(stripes)).cast("int"))
        left = left.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
        right = stored.withColumn("_d", F.pmod(F.xxhash64("docid"), F.lit(cells)).cast("int"))
        right = right.withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))

        def cell(q: pa.Table, d: pa.Table) -> pa.Table:
            if not q.num_rows or not d.num_rows:
                return out.empty_table()
            pieces = _blocks(iter(d.to_batches()), block)
            return pa.Table.from_batches(
                _search_blocks(pieces, _grouped_queries(q, by), by, k, tie, tie_desc, out), out
            )

        tasks = None
        found = left.groupBy("_q", "_d").cogroup(right.groupBy("_q", "_d")).applyInArrow(cell, schema)
    ranked = top_k(found, k, by=[*by, "qid"], tie=tie, tie_desc=tie_desc, tasks=tasks)
    return ranked.select(*by, "qid", "docid", "score", "rank")
