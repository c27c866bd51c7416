"""Tables that an encoder is trained on."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import HASH_DIGITS, hash_bucket_starts, seeded_hash
from rankframe.functions.sizing import broadcast_if_small
from rankframe.functions.text import PASSAGE_PREFIX, normalize_query, strip
from rankframe.operators.keys import positives, with_ids_of

COPIES_PER_STEP = 4096


def training_pairs(qrels: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """``(qid, docid, query_text, passage_text)`` for each positive judgment whose query and text exist.

    ``docs`` is ``(docid, text)`` without blank texts. Case is kept on both sides.
    """
    wanted = positives(qrels).select("qid", "docid")
    texts = with_ids_of(docs.select("docid", "text"), wanted)
    asked = broadcast_if_small(queries.select("qid", "query"))
    pairs = wanted.join(asked, "qid").join(texts, "docid")
    return pairs.select(
        "qid",
        "docid",
        normalize_query("query", "prefix").alias("query_text"),
        F.concat(F.lit(PASSAGE_PREFIX), strip("text")).alias("passage_text"),
    )


def training_batches(pairs: DataFrame, size: int = 8, seed: int = 0) -> DataFrame:
    """Pairs in a repeatable random order, cut into batches: ``position`` from 0 and ``batch``.

    The order is that of a seeded hash. A global row number would put all rows into one task; here each
    hash bucket is numbered by itself and shifted by the rows before it. Ids and a hash of the rest are numbered, and
    texts cross one exchange, to meet their positions. Copies of a pair are counted before the shuffle and laid out
    again after it.
    """
    columns = pairs.columns
    others = [c for c in columns if c not in ("qid", "docid")]
    keys = ["qid", "docid", "_h1", "_h2"]
    marked = pairs.withColumns({f"_h{i}": F.xxhash64(F.lit(i), *others) for i in (1, 2)})
    counted = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    hashed = counted.withColumn("_hash", seeded_hash(seed, "qid", "docid"))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    starts = hash_bucket_starts(hashed, "_hash", F.col("_copies")).select("_bucket", "_start")

    before = Window.partitionBy("_bucket").orderBy("_hash", *keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_copies").over(before), F.lit(0))
    placed = hashed.withColumn("_inside", inside).join(F.broadcast(starts), "_bucket")
    placed = placed.select(*keys, "_copies", (F.col("_start") + F.col("_inside")).alias("_first"))
    same = reduce(and_, [F.col(f"texts.{c}").eqNullSafe(F.col(f"placed.{c}")) for c in keys])
    whole = marked.dropDuplicates(keys).alias("texts").join(placed.alias("placed"), same)
    whole = whole.select(*[F.col(f"texts.{c}") for c in columns], "_copies", "_first")

    steps = F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(COPIES_PER_STEP).cast("long"))
    stepped = whole.withColumn("_from", F.explode(steps))
    last = F.least(F.col("_from") + F.lit(COPIES_PER_STEP), F.col("_copies")) - 1
    laid = stepped.withColumn("_copy", F.explode(F.sequence(F.col("_from"), last)))
    numbered = laid.withColumn("position", F.col("_first") + F.col("_copy"))
    batch = F.floor(F.col("position") / F.lit(size)).cast("long")
    return numbered.select("position", batch.alias("batch"), *columns)


def in_batch_negatives(batches: DataFrame) -> DataFrame:
    """``negatives``: the other documents of the row's batch, which holds no more rows than the batch size."""
    mates = F.collect_list(F.struct("position", "docid")).over(Window.partitionBy("batch"))
    others = F.filter(F.sort_array(mates), lambda mate: mate["position"] != F.col("position"))
    return batches.withColumn("negatives", F.transform(others, lambda mate: mate["docid"]))


def judged_plus_noise(docs: DataFrame, qrels: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """All judged documents and ``n`` of the others, the first in the order of a seeded hash.

    The cut falls in one hash bucket: the buckets before it are taken whole, and only it is ordered.
    Ids alone are shuffled; the documents are then filtered where they are read.
    """
    judged = qrels.select("docid").distinct()
    n_judged = judged.count()
    others = docs.select("docid").join(broadcast_if_small(judged, rows=n_judged), "docid", "left_anti")
    hashed = others.withColumn("_hash", seeded_hash(seed, "docid"))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, HASH_DIGITS))
    starts = hash_bucket_starts(hashed, "_hash").filter(F.col("_start") < n)
    near = hashed.join(F.broadcast(starts), "_bucket")
    whole = near.filter(F.col("_start") + F.col("_n") <= n)
    cut = near.filter(F.col("_start") + F.col("_n") > n)
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", "docid"))
    cut = cut.withColumn("_inside", inside).filter(F.col("_inside") <= F.lit(n) - F.col("_start"))
    chosen = whole.select("docid").unionByName(cut.select("docid")).unionByName(judged)
    return with_ids_of(docs, chosen, n_judged + n)
