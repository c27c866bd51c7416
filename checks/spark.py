"""One query per operator over the driver's whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rankframe as rf
from checks import tables as t
from checks.round_trips import COUNTS, ROUND_TRIPS, six
from rankframe.functions.ranking import written
from rankframe.functions.text import PASSAGE_PREFIX, is_blank
from rankframe.operators import lexical
from rankframe.operators.encoding import encode
from rankframe.operators.evaluation import mean_metric
from rankframe.operators.keys import unique_judgments
from rankframe.operators.training import in_batch_negatives
from rankframe.sources.readers import parse_documents
from rankframe.sources.writers import to_indexable, to_trec_lines

NOISE = 200
LANGS = ("de", "en", "es", "fr")
TEXT_FORMS = {
    "bm25_text": {"lower": True},
    "encode_text": {"strip_ends": True, "lower": True},
    "passage_text": {"strip_ends": True, "lower": True, "prefix": PASSAGE_PREFIX},
    "training_text": {"strip_ends": True, "prefix": PASSAGE_PREFIX},
    "rerank_text": {"strip_ends": True},
    "raw_text": {},
}


def texts(spark: SparkSession, sf: str) -> DataFrame:
    docs = t.corpus(spark, sf)
    return docs.select("docid", rf.assemble_text(strip_ends=True).alias("text")).filter(~is_blank("text"))


def text_assembly(spark: SparkSession, sf: str) -> DataFrame:
    forms = [F.md5(rf.assemble_text(**form)).alias(name) for name, form in TEXT_FORMS.items()]
    return t.corpus(spark, sf).select("docid", is_blank(rf.assemble_text()).alias("blank"), *forms)


def text_guard(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines whose title is a string, a list, a number or missing, by language."""
    docs, lang = t.corpus(spark, sf), F.col("snapshot")
    doc_id = F.col("docid").alias("id")
    line = (
        F.when(lang == "de", F.to_json(F.struct(doc_id, F.array("title").alias("title"), "abstract")))
        .when(lang == "fr", F.to_json(F.struct(doc_id, F.length("title").alias("title"), "abstract")))
        .when(lang == "es", F.to_json(F.struct(doc_id, "abstract")))
        .otherwise(F.to_json(F.struct(doc_id, "title", "abstract")))
    )
    parsed = parse_documents(docs.select(line.alias("value")))
    return parsed.select("docid", F.md5(rf.assemble_text(lower=True)).alias("bm25_text"))


def query_normalize(spark: SparkSession, sf: str) -> DataFrame:
    modes = ("prefix_lower", "strip", "raw", "prefix")
    forms = [rf.normalize_query("query", mode).alias(mode) for mode in modes]
    return t.queries(spark, sf).select("qid", *forms).withColumn("bare", rf.strip_prefix("prefix_lower"))


def dedupe_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rf.dedupe_by_id(t.copies(spark, sf), order=["seq"]).select("docid", "seq", "title")


def dedupe_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    return rf.dedupe_by_id(t.copies(spark, sf), order=["seq"], keep="first").select("docid", "seq", "title")


def judged_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return rf.judged_corpus(t.corpus(spark, sf), t.qrels(spark, sf)).select("docid", "title")


def available_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return rf.available_qrels(t.qrels(spark, sf), t.vectors(spark, sf)).select("qid", "docid", "relevance")


def positive_qrels(spark: SparkSession, sf: str) -> DataFrame:
    return rf.positives(t.qrels(spark, sf)).select("qid", "docid", "relevance")


def judged_plus_noise(spark: SparkSession, sf: str) -> DataFrame:
    return rf.judged_plus_noise(t.corpus(spark, sf), t.qrels(spark, sf), NOISE, seed=7).select("docid", "title")


def tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = lexical.doc_tokens(t.corpus(spark, sf))
    return words.select("docid", "dl", F.md5(F.array_join("tokens", " ")).alias("words"))


def postings(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.postings(lexical.doc_tokens(t.corpus(spark, sf)))


def doc_freq(spark: SparkSession, sf: str) -> DataFrame:
    return rf.build_index(t.corpus(spark, sf)).terms


def doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.doc_lengths(lexical.doc_tokens(t.corpus(spark, sf)))


def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rf.build_index(t.corpus(spark, sf)).stats.withColumn("avgdl", F.round("avgdl", 6))


def inverted_index(spark: SparkSession, sf: str) -> DataFrame:
    lists = lexical.inverted_index(postings(spark, sf), max_list=256)
    items = F.transform("postings", lambda p: F.concat_ws(":", p["docid"].cast("string"), p["tf"].cast("string")))
    return lists.select("term", "part", "n_parts", F.array_join(items, ",").alias("postings"))


def _six(df: DataFrame, *names: str) -> DataFrame:
    """What is shown has six decimals; what is ranked keeps all."""
    return df.withColumns({name: six(F.col(name)) for name in names})


def _judged_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return rf.bm25_search(t.queries(spark, sf), t.corpus(spark, sf), 200, qrels=t.qrels(spark, sf))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _six(_judged_bm25(spark, sf), "score")


def bm25_whole_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.bm25_search(t.queries(spark, sf), t.corpus(spark, sf), 200), "score")


def bm25_large_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """The way for a vocabulary that may not be broadcast: it is joined."""
    run = rf.bm25_search(t.queries(spark, sf), t.corpus(spark, sf), 20, broadcast_bytes=0)
    return _six(run, "score")


def search_bounded(spark: SparkSession, sf: str) -> DataFrame:
    """Short queries, the last two words of every benchmark text, from the blocks that can reach the ten best."""
    index = rf.build_index(t.corpus(spark, sf))
    return _six(lexical.bounded_search(index, t.short_queries(spark, sf), 10), "score")


def search_top10(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.search(rf.build_index(t.corpus(spark, sf)), t.queries(spark, sf), 10), "score")


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _six(t.dense_run(spark, sf, 200), "score")


def dense_topk_deep(spark: SparkSession, sf: str) -> DataFrame:
    """Deeper than the limit up to which Spark cuts a ranking before its shuffle of itself."""
    return _six(t.dense_run(spark, sf, 1500), "score")


def dense_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Over vectors laid out by pivots, where whole runs of them are out of reach of a query."""
    run = rf.dense_search(t.query_vectors(spark, sf), rf.by_pivot(t.vectors(spark, sf)), 200)
    return _six(run, "score")


def dense_near_ties(spark: SparkSession, sf: str) -> DataFrame:
    """Only rank and document: the scores of a pair agree in the decimals that are shown."""
    run = rf.dense_search(t.query_vectors(spark, sf), t.near_tied_vectors(spark, sf), 20)
    return run.select("qid", "docid", "rank")


def dense_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The way for more queries than a task may hold."""
    run = rf.dense_search(t.query_vectors(spark, sf), t.vectors(spark, sf), 100, query_bytes=100_000)
    return _six(run, "score")


def dense_topk_blocked(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of 1,000 vectors; the later of equal documents first."""
    stored = t.vectors(spark, sf).withColumn("position", F.col("docid"))
    run = rf.dense_search(t.query_vectors(spark, sf), stored, 100, tie="position", tie_desc=True, block=1000)
    return _six(run, "score")


def zero_based_rank(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.with_rank(t.dense_run(spark, sf).drop("rank"), base=0, depth=t.RUN_K), "score")


def weighted_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.weighted_fusion(t.expert_runs(spark, sf), (0.8, 0.1, 0.1), depth=t.RUN_K), "fused_score")


def weighted_fusion_default(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.weighted_fusion(t.expert_runs(spark, sf), depth=t.RUN_K), "fused_score")


def rrf(spark: SparkSession, sf: str) -> DataFrame:
    return rf.rrf(t.expert_runs(spark, sf), depth=t.RUN_K)


def rrf_derive_rank(spark: SparkSession, sf: str) -> DataFrame:
    return rf.rrf([run.drop("rank") for run in t.expert_runs(spark, sf)], depth=t.RUN_K)


def weighted_fusion_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Full outer joins, for runs that may repeat a document, ranked without a known depth."""
    return _six(rf.weighted_fusion(t.expert_runs(spark, sf), unique=False), "fused_score")


def _rerank(spark: SparkSession, sf: str, missing: str) -> DataFrame:
    run = t.sparse_run(spark, sf)
    return _six(rf.rerank(run, t.queries(spark, sf), texts(spark, sf), rf.token_jaccard, missing, depth=t.RUN_K), "score")


def rerank_small_scores(spark: SparkSession, sf: str) -> DataFrame:
    """A scorer whose scores differ beyond the decimals that are shown."""
    scorer = lambda query, text: rf.token_jaccard(query, text) * F.lit(1e-7)
    run = rf.rerank(t.dense_run(spark, sf), t.queries(spark, sf), texts(spark, sf), scorer, depth=t.RUN_K)
    return run.select("qid", "docid", "rank")


def rerank_drop(spark: SparkSession, sf: str) -> DataFrame:
    return _rerank(spark, sf, "drop")


def rerank_blank(spark: SparkSession, sf: str) -> DataFrame:
    return _rerank(spark, sf, "blank")


def rerank_from_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    stored = t.vectors(spark, sf).withColumn("position", F.col("docid"))
    run = rf.rerank_from_embeddings(
        t.query_vectors(spark, sf), stored, texts(spark, sf), rf.token_jaccard, t.RUN_K, position="position"
    )
    return _six(run, "score")


def ndcg_per_query(spark: SparkSession, sf: str) -> DataFrame:
    per_query = rf.ndcg_per_query(_judged_bm25(spark, sf), t.qrels(spark, sf), depth=200)
    return _six(per_query, "dcg", "idcg", "ndcg")


def ndcg_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _six(rf.evaluate(_judged_bm25(spark, sf), t.qrels(spark, sf), depth=200), "ndcg")


def ndcg_constant_score(spark: SparkSession, sf: str) -> DataFrame:
    run, judged = t.dense_run(spark, sf), rf.available_qrels(t.qrels(spark, sf), t.vectors(spark, sf))
    per_query = rf.ndcg_per_query(run, judged, score_mode="constant", depth=t.RUN_K)
    return _six(per_query, "dcg", "idcg", "ndcg")


def ndcg_at_k_standard(spark: SparkSession, sf: str) -> DataFrame:
    per_query = rf.ndcg_per_query(
        _judged_bm25(spark, sf),
        t.qrels(spark, sf),
        k=10,
        ideal="all_judged",
        missing_queries="zero",
        depth=200,
    )
    return _six(per_query, "dcg", "idcg", "ndcg")


def qrels_map(spark: SparkSession, sf: str) -> DataFrame:
    entries = F.array_sort(F.map_entries("judgments"))
    items = F.transform(entries, lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string")))
    return rf.qrels_map(t.qrels(spark, sf)).select("qid", F.array_join(items, ",").alias("judgments"))


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    return rf.coverage(texts(spark, sf), t.qrels(spark, sf), t.sparse_run(spark, sf))


def qrels_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Every judgment twice, the second one point lower and later: the later counts, not the higher."""
    first = t.qrels(spark, sf).withColumn("seq", F.lit(1))
    second = first.withColumns({"seq": F.lit(2), "relevance": F.greatest(F.col("relevance") - 1, F.lit(0))})
    return unique_judgments(first.unionByName(second), order=["seq"]).select("qid", "docid", "relevance")


def training_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return rf.training_pairs(t.qrels(spark, sf), t.queries(spark, sf), texts(spark, sf))


def training_batches(spark: SparkSession, sf: str) -> DataFrame:
    batches = rf.training_batches(training_pairs(spark, sf), 8, seed=3)
    others = F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives")
    return in_batch_negatives(batches).select("position", "batch", "qid", "docid", others)


def trec_lines(spark: SparkSession, sf: str) -> DataFrame:
    return to_trec_lines(bm25_topk(spark, sf), "bm25")


def indexable_docs(spark: SparkSession, sf: str) -> DataFrame:
    return to_indexable(t.corpus(spark, sf))


def snapshot_runs(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked, stored = t.snapshot_inputs(spark, sf)
    return _six(rf.snapshot_runs(docs, asked, stored, rf.token_jaccard, 100), "score")


def _snapshot_dense(spark: SparkSession, sf: str) -> DataFrame:
    """Every query in every snapshot, so that equal query ids meet under the key."""
    docs, _, stored = t.snapshot_inputs(spark, sf)
    asked = t.query_vectors(spark, sf).withColumn("snapshot", F.explode(F.array(*[F.lit(s) for s in LANGS])))
    return rf.dense_search(asked, stored, 100, by=["snapshot"])


def snapshot_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    run = _snapshot_dense(spark, sf)
    home = t.corpus(spark, sf).select("docid", "snapshot")
    judged = t.qrels(spark, sf).join(home, "docid")
    return _six(rf.ndcg_per_query(run, judged, by=["snapshot"], depth=100), "dcg", "idcg", "ndcg")


def snapshot_rrf(spark: SparkSession, sf: str) -> DataFrame:
    run = written(_snapshot_dense(spark, sf))
    turned = run.withColumn("rank", F.lit(101) - F.col("rank"))
    return rf.rrf([run, turned], by=["snapshot"], depth=100)


def _hybrid(spark: SparkSession, sf: str):
    return rf.hybrid_pipeline(
        t.expert_runs(spark, sf),
        t.queries(spark, sf),
        texts(spark, sf),
        t.qrels(spark, sf),
        rf.token_jaccard,
        depth=t.RUN_K,
    )


def hybrid_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return _six(_hybrid(spark, sf).reranked, "score")


def hybrid_ndcg(spark: SparkSession, sf: str) -> DataFrame:
    return _six(mean_metric(_hybrid(spark, sf).ndcg), "ndcg")


def encode_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The model hook with a stand-in that counts characters and words."""
    vectors = encode(texts(spark, sf), COUNTS)
    parts = [F.col("embedding")[i].cast("long").alias(name) for i, name in enumerate(("chars", "words"))]
    return vectors.select("docid", *parts)


QUERIES = {
    f.__name__: f
    for f in (
        text_assembly,
        text_guard,
        query_normalize,
        dedupe_last_wins,
        dedupe_first_wins,
        judged_corpus,
        available_qrels,
        positive_qrels,
        judged_plus_noise,
        tokens,
        postings,
        doc_freq,
        doc_lengths,
        corpus_stats,
        inverted_index,
        bm25_topk,
        bm25_whole_corpus,
        bm25_large_vocabulary,
        search_top10,
        search_bounded,
        dense_topk,
        dense_topk_blocked,
        dense_topk_deep,
        dense_pruned,
        dense_near_ties,
        dense_grid,
        zero_based_rank,
        weighted_fusion,
        weighted_fusion_default,
        weighted_fusion_repeats,
        rrf,
        rrf_derive_rank,
        rerank_drop,
        rerank_blank,
        rerank_small_scores,
        rerank_from_embeddings,
        ndcg_per_query,
        ndcg_mean,
        ndcg_constant_score,
        ndcg_at_k_standard,
        qrels_map,
        qrels_last_wins,
        coverage,
        training_pairs,
        training_batches,
        trec_lines,
        indexable_docs,
        snapshot_runs,
        snapshot_ndcg,
        snapshot_rrf,
        hybrid_pipeline,
        hybrid_ndcg,
        encode_documents,
    )
} | ROUND_TRIPS
