"""Times the headline queries, warm, and prints one JSON line.

``BENCH_SF_DIR`` is the table folder, ``BENCH_CPUS`` the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from checks.compare import local_session
from checks.spark import QUERIES

HEADLINE = (
    "tokens",
    "postings",
    "inverted_index",
    "dedupe_last_wins",
    "bm25_topk",
    "bm25_whole_corpus",
    "search_top10",
    "dense_topk",
    "dense_topk_blocked",
    "weighted_fusion",
    "rrf",
    "rerank_drop",
    "rerank_from_embeddings",
    "ndcg_per_query",
    "ndcg_at_k_standard",
    "judged_plus_noise",
    "training_batches",
    "snapshot_runs",
    "hybrid_ndcg",
)


def timed(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in names or HEADLINE:
        timed(spark, sf_dir, name)
        seconds[name] = round(min(timed(spark, sf_dir, name) for _ in range(2)), 3)
        print(f"{name:26} {seconds[name]:8.3f}s", file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    sf = Path(sf_dir).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": seconds, "sf": float(sf)}))


if __name__ == "__main__":
    main(sys.argv[1:])
