"""Ranking runs on Spark: build them, combine them, judge them."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

from rankframe.functions.ranking import top_k, with_rank
from rankframe.functions.scoring import PairScorer, cosine, token_jaccard
from rankframe.functions.text import assemble_text, normalize_query, strip_prefix, tokenize
from rankframe.operators.dense import by_pivot, dense_search
from rankframe.operators.encoding import embeddings_or_compute, encode, model_scorer
from rankframe.operators.evaluation import coverage, evaluate, mean_metric, ndcg_per_query, qrels_map
from rankframe.operators.fusion import rrf, weighted_fusion
from rankframe.operators.keys import available_qrels, dedupe_by_id, judged_corpus, positives
from rankframe.operators.lexical import Index, bm25_search, bounded_search, build_index, search
from rankframe.operators.rerank import hydrate, rerank
from rankframe.operators.training import judged_plus_noise, training_batches, training_pairs
from rankframe.plans.hybrid import hybrid_pipeline
from rankframe.plans.snapshots import rerank_from_embeddings, run_snapshots, snapshot_runs

# Task functions travel with their code, so that executors do not need the package installed.
register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "Index",
    "PairScorer",
    "assemble_text",
    "available_qrels",
    "bm25_search",
    "bounded_search",
    "build_index",
    "by_pivot",
    "cosine",
    "coverage",
    "dedupe_by_id",
    "dense_search",
    "embeddings_or_compute",
    "encode",
    "evaluate",
    "hybrid_pipeline",
    "hydrate",
    "judged_corpus",
    "judged_plus_noise",
    "mean_metric",
    "model_scorer",
    "ndcg_per_query",
    "normalize_query",
    "positives",
    "qrels_map",
    "rerank",
    "rerank_from_embeddings",
    "rrf",
    "run_snapshots",
    "search",
    "snapshot_runs",
    "strip_prefix",
    "token_jaccard",
    "tokenize",
    "top_k",
    "training_batches",
    "training_pairs",
    "weighted_fusion",
    "with_rank",
]
