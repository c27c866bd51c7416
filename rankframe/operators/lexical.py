"""Term statistics, the index tables, and BM25 search over either."""

from __future__ import annotations

from math import ceil
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import stored, top_k, written
from rankframe.functions.scoring import idf, rounded_sum, tf_saturation
from rankframe.functions.sizing import BROADCAST_BYTES, broadcast_if_small, fits_broadcast
from rankframe.functions.text import assemble_text, tokenize
from rankframe.operators.keys import judged_corpus, split_heavy

DOCUMENT_MARK = ""
"""Stands among a document's words once per document. No word is empty, so its document frequency is the
number of documents and its lengths add up to the number of words."""

BUCKETS = 64
"""Folders of postings in a stored index, by a hash of the term."""

SEED_DEPTH = 4
"""A search takes its first threshold from the best blocks of each query that hold this many times k postings."""

SLACK = 1e-6
"""Bounds are sums in another order than scores: a block counts as out of reach only below the threshold by this much."""

TASK_SUMS = 1 << 20
"""Scores, of a query and a document, that one task adds up, about 300 bytes each."""

TASK_ROWS = 1 << 21
"""Postings that one task sorts, about 100 bytes each."""

TASK_DOCS = 1 << 18
"""Documents of one word that meet a joined vocabulary in one task."""

WORD_BYTES = 6
"""Of text, for a guess at the number of its words."""


class Index(NamedTuple):
    """``postings(term, bucket, block, docid, tf, dl)``, ``blocks(term, bucket, block, n, max_tf, min_dl)``,
    ``terms(term, df)`` and the one row ``stats(n, total, avgdl)``.

    A block holds a term's postings of like frequency and document length (each within a factor of two), so that its
    largest frequency and least length bound the score of every posting in it closely, for any k1 and b.
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    stats: DataFrame


def doc_tokens(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``(docid, tokens, dl)``. Documents need one row per id."""
    words = tokenize(assemble_text(lower=True) if text is None else text)
    return docs.select("docid", words.alias("tokens")).withColumn("dl", F.size("tokens"))


def term_counts(tokens: Column) -> Column:
    """The distinct words of an array with how often each occurs, counted inside the row: equal words are neighbours
    once sorted, and a run's length is the distance between its end and the one before."""

    def runs(words: Column) -> Column:
        end = lambda word, i: F.when(word.eqNullSafe(F.get(words, i + 1)), F.lit(None)).otherwise(i + 1)
        ends = F.array_compact(F.transform(words, end))

        def counted(ends: Column) -> Column:
            length = lambda end, i: end - F.coalesce(F.get(ends, i - 1), F.lit(0))
            run = lambda end, i: F.struct(F.get(words, end - 1).alias("term"), length(end, i).cast("long").alias("tf"))
            return F.transform(ends, run)

        return F.transform(F.array(ends), counted)[0]

    # The array of one binds the sorted words, and the ends of their runs, to a name; without it every look at a word
    # would sort them again.
    return F.transform(F.array(F.sort_array(tokens)), runs)[0]


def doc_terms(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """``(docid, dl, terms)``, one row for each document: the words of its text with their counts."""
    return doc_tokens(docs, text).select("docid", "dl", term_counts(F.col("tokens")).alias("terms"))


def postings(tokens: DataFrame) -> DataFrame:
    """Term frequency of each (document, term), from ``doc_tokens``, without a shuffle.

    The outer explode keeps the optimizer from adding a ``size(terms) > 0`` filter, which it would push
    down to the scan and tokenize every text a second time for.
    """
    return _posting_rows(tokens.select("docid", "dl", term_counts(F.col("tokens")).alias("terms")))


def _posting_rows(counted: DataFrame) -> DataFrame:
    rows = counted.select("docid", "dl", F.explode_outer("terms").alias("_term")).filter(F.col("_term").isNotNull())
    return rows.select("docid", "_term.term", "_term.tf", "dl")


def doc_freq(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_lengths(tokens: DataFrame) -> DataFrame:
    return tokens.select("docid", "dl")


def corpus_stats(tokens: DataFrame) -> DataFrame:
    """One row: number of documents, of words, and words per document (null for no documents)."""
    counts = tokens.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("total")
    )
    return counts.withColumn("avgdl", F.try_divide(F.col("total").cast("double"), F.col("n")))


def _dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` over ``tasks`` tasks at least, a number that Spark does not lower. Where one would do, Spark chooses."""
    return df.repartition(_spread(df, tasks), *keys) if tasks > 1 else df.repartition(*keys)


def _spread(df: DataFrame, tasks: int) -> int:
    return max(tasks, df.sparkSession.sparkContext.defaultParallelism)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _block() -> Column:
    """Number of a posting's block among those of its term: frequency and length by powers of two."""
    return F.floor(F.log2("tf")).cast("int") * F.lit(32) + F.floor(F.log2("dl")).cast("int")


def block_bounds(posting_rows: DataFrame) -> DataFrame:
    return posting_rows.groupBy("term", "bucket", "block").agg(
        F.count(F.lit(1)).alias("n"), F.max("tf").alias("max_tf"), F.min("dl").alias("min_dl")
    )


def build_index(docs: DataFrame, text: Column | None = None) -> Index:
    """The tables of an index. Words are counted once and stored by document; all tables are read from there."""
    counted = stored(doc_terms(docs, text))
    rows = _posting_rows(counted).withColumns({"bucket": _bucket("term"), "block": _block()})
    blocks = block_bounds(rows)
    return Index(rows, blocks, blocks.groupBy("term").agg(F.sum("n").alias("df")), corpus_stats(counted))


def inverted_index(
    posting_rows: DataFrame, terms: DataFrame | None = None, max_list: int = 100_000
) -> DataFrame:
    """Postings as lists, ``(term, part, n_parts, postings)``, each list sorted by document.

    A word that stands in a third of the corpus would be one endless row, so lists longer than about
    ``max_list`` are split over parts. ``terms`` are the document frequencies, where they are stored; to count them the
    postings are stored, so that whatever makes them runs once. They are dealt out as rows before they are gathered: in
    a large corpus a task has hardly two postings of a list, and lists of one are larger than rows.
    """
    rows = posting_rows.select("term", "docid", "tf")
    if terms is None:
        rows = stored(rows)
        counts, n = doc_freq(rows), rows.count()
    else:
        counts, n = terms, terms.agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n")).first()["n"]
    parted = split_heavy(rows, "term", counts.select("term", F.col("df").alias("n")), max_list)
    laid = _dealt(parted.withColumn("_posting", F.struct("docid", "tf")), ceil(n / TASK_ROWS), "term", "part")
    lists = laid.groupBy("term", "part").agg(
        F.max("n_parts").alias("n_parts"), F.sort_array(F.collect_list("_posting")).alias("postings")
    )
    return lists.select("term", "part", "n_parts", "postings")


def query_terms(queries: DataFrame) -> DataFrame:
    """Words of each query with how often the query repeats them."""
    words = queries.select("qid", F.explode_outer(tokenize("query")).alias("term")).filter(F.col("term").isNotNull())
    return words.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def _sum_tasks(docs: int, wanted: DataFrame) -> int:
    """Tasks for the scores of every document with every query."""
    return ceil(docs * wanted.select("qid").distinct().count() / TASK_SUMS)


def _rank(matches: DataFrame, weights: DataFrame, k: int, k1: float, b: float, tasks: int) -> DataFrame:
    """Score and cut. ``matches`` is dealt over ``tasks`` by document and its length, and stays so: every step up to
    the cut works inside a partition, and what crosses the network is k rows per query and task."""
    share = F.col("weight") * tf_saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return _best(matches.join(weights, "term").withColumn("share", share), k, tasks)


def _best(shares: DataFrame, k: int, tasks: int) -> DataFrame:
    run = shares.groupBy("qid", "docid", "dl").agg(rounded_sum(F.sum("share")).alias("score"))
    best = top_k(run, k, tasks=_spread(run, tasks) if tasks > 1 else None)
    return best.select("qid", "docid", "score", "rank")


def _rank_joined(matches: DataFrame, weights: DataFrame, k: int, k1: float, b: float, tasks: int) -> DataFrame:
    """``_rank`` with weights that are joined. A word meets its queries in several parts, by a hash of the document, where
    it has more documents times queries than ``TASK_SUMS``, and the shares are dealt by document afterwards."""
    meetings = weights.groupBy("term", "df").agg(F.count(F.lit(1)).alias("n"))
    meetings = written(meetings.select("term", (F.col("n") * F.col("df")).alias("n")))
    n = ceil((meetings.agg(F.sum("n").alias("n")).first()["n"] or 0) / TASK_SUMS)
    parted = split_heavy(matches, "term", meetings, TASK_SUMS).withColumn("part", F.coalesce("part", F.lit(0)))
    last = F.ceil(F.col("n") / F.lit(TASK_SUMS)).cast("int") - 1
    parts = meetings.select("term", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    met = _dealt(parted.drop("n_parts"), n, "term", "part").join(
        _dealt(weights.join(parts, "term"), n, "term", "part"), ["term", "part"]
    )
    share = F.col("weight") * tf_saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return _best(_dealt(met.select("qid", "docid", "dl", share.alias("share")), tasks, "docid", "dl"), k, tasks)


def _of_words(rows: DataFrame, vocabulary: DataFrame, small: bool, docs: int, words: int) -> DataFrame:
    """Postings of the vocabulary, about ``words`` of ``docs`` documents before the cut. A small vocabulary is broadcast.
    Any other is joined, each word in slices of ``TASK_DOCS`` documents, so that no task has all of a frequent one."""
    if small:
        return rows.join(F.broadcast(vocabulary), "term", "left_semi")
    slices, n = max(ceil(docs / TASK_DOCS), 1), ceil(words / TASK_ROWS)
    sliced = rows.withColumn("_slice", F.pmod(F.xxhash64("docid"), F.lit(slices)).cast("int"))
    asked = vocabulary.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    keys = ["term", "_slice"]
    return _dealt(sliced, n, *keys).join(_dealt(asked, n, *keys), keys, "left_semi").select(*rows.columns)


def _weights(terms: DataFrame, term_stats: DataFrame, totals: DataFrame) -> DataFrame:
    """Weight of each query term. Words that no document has drop out in the join."""
    both = F.struct(*[F.col(c).cast("double").alias(c) for c in ("n", "total")])
    total = totals.select(both).scalar()
    known = terms.join(term_stats.select("term", "df"), "term").withColumn("_of", total)
    return known.select(
        "qid",
        "term",
        "df",
        (F.col("qtf") * idf(F.col("_of")["n"], F.col("df"))).alias("weight"),
        F.try_divide(F.col("_of")["total"], F.col("_of")["n"]).alias("avgdl"),
    )


def bm25_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 200,
    *,
    qrels: DataFrame | None = None,
    k1: float = 1.5,
    b: float = 0.75,
    text: Column | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """BM25 top-k straight from documents (one row per id) in one pass over them.

    With ``qrels`` only judged documents count, also for document frequencies and lengths. Words are counted inside
    their document's row. The query vocabulary, where it measures up to ``broadcast_bytes``, is broadcast into the
    scan, so that a word no query uses is gone before the shuffle. The shuffle is by document and length, not by document alone: Spark
    drops a repartitioning that documents already have (from ``dedupe_by_id``, say), and each reader of the
    exchange would tokenize for itself.

    The documents are counted first, without reading their texts, and dealt over so many tasks that none adds up more
    than about ``TASK_SUMS`` scores. A joined vocabulary has the texts measured, and the postings of its words stored.
    """
    if qrels is not None:
        docs = judged_corpus(docs, qrels)
    wanted = query_terms(queries)
    small = fits_broadcast(wanted, broadcast_bytes)

    marked = queries.sparkSession.range(1).select(F.lit(DOCUMENT_MARK).alias("term"))
    vocabulary = wanted.select("term").distinct().unionByName(marked)
    mark = F.struct(F.lit(DOCUMENT_MARK).alias("term"), F.lit(1).cast("long").alias("tf"))
    words = doc_terms(docs, text).select("docid", "dl", F.inline(F.array_append("terms", mark)))
    if small:
        n_docs = docs.count()
        tasks = _sum_tasks(n_docs, wanted)
        matches = _dealt(_of_words(words, vocabulary, True, n_docs, 0), tasks, "docid", "dl")
    else:
        octets = F.octet_length(assemble_text() if text is None else text)
        n_docs, octets = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(octets), F.lit(0))).first()
        tasks = _sum_tasks(n_docs, wanted)
        matches = stored(_of_words(words, vocabulary, False, n_docs, octets // WORD_BYTES))
    # Counting by tf keeps that column in this reader of the exchange, as in the other; with fewer columns it would be
    # an exchange of its own, and every text would be read a second time.
    term_stats = matches.groupBy("term").agg(
        F.count_if(F.col("tf") > 0).alias("df"), F.sum("dl").cast("long").alias("total")
    )
    is_mark = F.col("term") == DOCUMENT_MARK
    totals = term_stats.agg(
        F.max(F.when(is_mark, F.col("df"))).alias("n"), F.max(F.when(is_mark, F.col("total"))).alias("total")
    )
    # Asking for both columns keeps the plans of frequencies and totals alike, so they share one exchange.
    frequencies = term_stats.filter(F.col("total") >= 0)
    weights = _weights(wanted, frequencies, totals)
    if small:
        return _rank(matches, F.broadcast(weights), k, k1, b, tasks)
    return _rank_joined(matches, written(weights), k, k1, b, tasks)


def _parts(posting_rows: DataFrame, blocks: DataFrame, k1: float, b: float) -> DataFrame:
    """Each posting's share of the score of every query that has its block in ``blocks``, dealt out by document."""
    needed = posting_rows.join(broadcast_if_small(blocks.select("term", "block").distinct()), ["term", "block"], "left_semi")
    dealt = needed.repartition("docid").join(broadcast_if_small(blocks), ["term", "block"])
    share = F.col("weight") * tf_saturation(F.col("tf"), F.col("dl"), F.col("avgdl"), k1, b)
    return dealt.select("qid", "docid", share.alias("part"))


def _opened(index: Index, wanted: DataFrame) -> Index:
    """The index, postings and bounds cut to the buckets of the wanted words. A stored index opens no other folder."""
    buckets = [row["bucket"] for row in wanted.select(_bucket("term").alias("bucket")).distinct().collect()]
    kept = {name: getattr(index, name).filter(F.col("bucket").isin(buckets)) for name in ("postings", "blocks")}
    return index._replace(**kept)


def search(index: Index, queries: DataFrame, k: int = 10, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """BM25 top-k from index tables: all postings of the queries' words, once. The buckets to open are collected, at most
    ``BUCKETS`` numbers; words are joined, however many there are."""
    wanted = query_terms(queries)
    small = fits_broadcast(wanted)
    vocabulary = wanted.select("term").distinct()
    size = index.stats.first()
    tasks = _sum_tasks(size["n"], wanted)
    rows = _opened(index, wanted).postings.select("docid", "dl", "term", "tf")
    matches = _of_words(rows, vocabulary, small, size["n"], size["total"])
    if not small:
        return _rank_joined(stored(matches), written(_weights(wanted, index.terms, index.stats)), k, k1, b, tasks)
    terms = index.terms.join(F.broadcast(vocabulary), "term", "left_semi")
    return _rank(_dealt(matches, tasks, "docid", "dl"), F.broadcast(_weights(wanted, terms, index.stats)), k, k1, b, tasks)


def bounded_search(index: Index, queries: DataFrame, k: int = 10, *, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The same run as ``search``, from the blocks that can matter: for short queries over a large corpus, where one
    frequent word would bring in all its documents.

    A block's bound is the highest share of a score that a posting of it can have. The postings of each query's best
    blocks give k documents, and with their shares a threshold that the k-th score reaches at least. With the query's
    terms in order of their highest bounds, a block is essential if its bound and the highest ones of all terms before
    reach that threshold: a document without a posting in an essential block cannot, whatever else it holds. So
    candidates come from the essential blocks, and only a candidate's other postings are looked up. In long queries the
    bounds of many words add up to more than any score, and ``search`` is the faster way.
    """
    wanted = query_terms(queries)
    small = fits_broadcast(wanted)
    hint = F.broadcast if small else (lambda df: df)
    vocabulary = wanted.select("term").distinct()
    size = index.stats.first()
    rows, blocks = _opened(index, wanted)[:2]
    # Every step below reads the postings and bounds of the wanted words alone.
    rows = stored(_of_words(rows, vocabulary, small, size["n"], size["total"]))
    blocks = written(blocks.join(hint(vocabulary), "term", "left_semi"))
    terms = blocks.groupBy("term").agg(F.sum("n").alias("df"))

    weights = hint(_weights(wanted, terms, index.stats))
    bound = F.col("weight") * tf_saturation(F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b)
    bounded = written(blocks.join(weights, "term").select("qid", "term", "block", "n", "weight", "avgdl", bound.alias("bound")))

    by_bound = Window.partitionBy("qid").orderBy(F.desc("bound"), "term", "block").rowsBetween(Window.unboundedPreceding, -1)
    seeds = bounded.withColumn("_before", F.sum("n").over(by_bound)).filter(F.coalesce("_before", F.lit(0)) < SEED_DEPTH * k)
    begun = _parts(rows, seeds, k1, b).groupBy("qid", "docid").agg(F.sum("part").alias("score"))
    reached = top_k(begun, k).filter(F.col("rank") == k).select("qid", F.col("score").alias("threshold"))

    highest = bounded.groupBy("qid", "term").agg(F.max("bound").alias("_highest"))
    by_term = Window.partitionBy("qid").orderBy("_highest", "term").rowsBetween(Window.unboundedPreceding, -1)
    highest = highest.select("qid", "term", F.coalesce(F.sum("_highest").over(by_term), F.lit(0.0)).alias("_below"))
    judged = bounded.join(highest, ["qid", "term"]).join(reached, "qid", "left")
    in_reach = F.col("threshold").isNull() | (F.col("bound") + F.col("_below") >= F.col("threshold") - SLACK)
    judged = written(judged.withColumn("essential", in_reach).drop("_below"))

    others = judged.filter(~F.col("essential"))
    spare = others.groupBy("qid", "term").agg(F.max("bound").alias("_most")).groupBy("qid").agg(F.sum("_most").alias("spare"))
    limits = judged.groupBy("qid").agg(F.max("threshold").alias("threshold")).join(spare, "qid", "left")
    found = _parts(rows, judged.filter("essential"), k1, b).groupBy("qid", "docid").agg(F.sum("part").alias("part"))
    found = found.join(broadcast_if_small(limits), "qid")
    open_ = F.col("threshold").isNull() | (F.col("part") + F.coalesce("spare", F.lit(0.0)) >= F.col("threshold") - SLACK)
    candidates = written(found.filter(open_).select("qid", "docid", "part"))

    wanted_docs = broadcast_if_small(candidates.select("docid").distinct())
    left = _parts(rows.join(wanted_docs, "docid", "left_semi"), others, k1, b).join(broadcast_if_small(candidates.select("qid", "docid")), ["qid", "docid"], "left_semi")
    scored = candidates.unionByName(left).groupBy("qid", "docid").agg(rounded_sum(F.sum("part")).alias("score"))
    return top_k(scored, k).select("qid", "docid", "score", "rank")
