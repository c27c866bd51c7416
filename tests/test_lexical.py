from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import rankframe.operators.lexical as lexical
from rankframe import bm25_search, build_index, dedupe_by_id, judged_corpus
from rankframe.operators.lexical import doc_tokens, inverted_index, postings
from rankframe.sources import readers, writers


def brute_bm25(queries, docs, k, k1=1.5, b=0.75):
    tf = {d: Counter(text.lower().split()) for d, text in docs.items()}
    length = {d: sum(c.values()) for d, c in tf.items()}
    n, avg = len(docs), sum(length.values()) / len(docs)
    out = []
    for qid, query in queries.items():
        terms = query.lower().split()
        scores = {}
        for d in docs:
            if not any(tf[d][t] for t in terms):
                continue
            total = 0.0
            for t in terms:
                df = sum(1 for c in tf.values() if c[t])
                if df:
                    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
                    total += idf * tf[d][t] * (k1 + 1) / (tf[d][t] + k1 * (1 - b + b * length[d] / avg))
            scores[d] = round(total, 6)
        best = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        out += [(qid, d, pytest.approx(s, abs=2e-6), i + 1) for i, (d, s) in enumerate(best)]
    return sorted(out, key=lambda r: (r[0], r[3]))


DOCS = {f"d{i:03}": " ".join(["the"] * (i % 4) + [f"w{(i * j) % 11}" for j in range(i % 9)]) for i in range(60)}
QUERIES = {"q1": "the w1 w1", "q2": "W3 unknown w5 w7", "q3": "nothing", "q4": "the"}


@pytest.fixture(scope="module")
def frames(spark):
    docs = spark.createDataFrame([(d, t, None) for d, t in DOCS.items()], "docid string, title string, abstract string")
    return docs, spark.createDataFrame(list(QUERIES.items()), "qid string, query string")


def ordered(run):
    return sorted((tuple(r) for r in run.collect()), key=lambda r: (r[0], r[3]))


def test_bm25_is_brute_force(frames):
    docs, queries = frames
    assert ordered(bm25_search(queries, docs, 200)) == brute_bm25(QUERIES, DOCS, 200)
    assert ordered(bm25_search(queries, docs, 5, k1=0.9, b=0.4)) == brute_bm25(QUERIES, DOCS, 5, 0.9, 0.4)


def test_judged_documents_change_the_statistics(spark, frames):
    docs, queries = frames
    kept = {d: t for i, (d, t) in enumerate(DOCS.items()) if i % 2}
    qrels = spark.createDataFrame([("q1", d) for d in kept] * 2 + [("q1", "gone")], "qid string, docid string")
    assert ordered(bm25_search(queries, docs, 200, qrels=qrels)) == brute_bm25(QUERIES, kept, 200)


def test_partitioning_does_not_matter(frames):
    docs, queries = frames
    assert ordered(bm25_search(queries.repartition(3), docs.repartition(7), 10)) == ordered(bm25_search(queries, docs.coalesce(1), 10))


def test_too_large_a_vocabulary_is_joined(frames, monkeypatch):
    docs, queries = frames
    want = ordered(bm25_search(queries, docs, 10))
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *a: False)
    assert ordered(bm25_search(queries, docs, 10)) == want
    assert ordered(lexical.search(build_index(docs), queries, 10)) == want


@pytest.mark.parametrize("k", [1, 3, 200])
def test_bounded_search_is_exact(frames, k):
    docs, queries = frames
    index = build_index(docs)
    assert ordered(lexical.bounded_search(index, queries, k)) == brute_bm25(QUERIES, DOCS, k)
    assert ordered(lexical.bounded_search(index, queries, k, k1=0.9, b=0.4)) == brute_bm25(QUERIES, DOCS, k, 0.9, 0.4)


def test_bounded_search_leaves_frequent_words_out(spark, monkeypatch):
    """A rare and a frequent word: only documents with the rare one are scored."""
    texts = {f"d{i:04}": " ".join(["the"] * (1 + i % 3) + [f"x{i}"] * 8 + ["rare"] * (i % 100 == 0)) for i in range(2000)}
    docs = spark.createDataFrame([(d, t, None) for d, t in texts.items()], "docid string, title string, abstract string")
    queries = spark.createDataFrame([("q", "the rare")], "qid string, query string")
    stored = []
    monkeypatch.setattr(lexical, "written", lambda df: stored.append(df.cache()) or stored[-1])
    got = ordered(lexical.bounded_search(build_index(docs), queries, 10))
    assert got == brute_bm25({"q": "the rare"}, texts, 10)
    assert 10 <= sum(df.count() for df in stored if "part" in df.columns) <= 20


def test_every_text_is_tokenized_once(frames, tmp_path):
    docs, queries = frames
    index = build_index(docs)
    for table in (*index, lexical.search(index, queries, 10)):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "split(" not in plan or "query" in plan
        assert "title" not in plan and "abstract" not in plan


def test_stored_index_opens_only_the_buckets_of_the_words(spark, frames, tmp_path):
    docs, queries = frames
    writers.write_index(build_index(docs), str(tmp_path / "index"))
    index = readers.read_index(spark, str(tmp_path / "index"))
    assert ordered(lexical.search(index, queries, 200)) == brute_bm25(QUERIES, DOCS, 200)
    assert ordered(lexical.bounded_search(index, queries, 5)) == brute_bm25(QUERIES, DOCS, 5)
    many = spark.createDataFrame([("q", " ".join(f"w{i}" for i in range(14)))], "qid string, query string")
    plan = lexical.search(index, many, 10)._jdf.queryExecution().executedPlan().toString()
    line = next(line for line in plan.splitlines() if "FileScan" in line and "tf#" in line)
    listed = re.search(r"PartitionFilters: \[([^\]]*)", line).group(1)
    assert "bucket" in listed and 5 < listed.count(",") < 16


def test_counts_are_made_below_the_first_exchange(frames):
    docs, queries = frames
    plan = bm25_search(queries, docs, 10)._jdf.queryExecution().executedPlan().toString()
    exchange = next(line for line in plan.splitlines() if "REPARTITION_BY_COL" in line)
    below = plan.split(exchange)[1].splitlines()[1]
    assert "tf#" in below and plan.count("FileScan") == plan.count("LocalTable") == 0



def test_index_tables(frames):
    docs, _ = frames
    index = build_index(docs)
    tf = {(d, t): n for d, text in DOCS.items() for t, n in Counter(text.split()).items()}
    assert {(r["docid"], r["term"]): r["tf"] for r in index.postings.collect()} == tf
    assert {r["term"]: r["df"] for r in index.terms.collect()} == Counter(t for _, t in tf)
    assert tuple(index.stats.first()) == (60, sum(tf.values()), sum(tf.values()) / 60)


def test_no_documents(spark, frames):
    docs, queries = frames
    none = docs.filter(F.lit(False))
    assert build_index(none).stats.first()["avgdl"] is None
    assert bm25_search(queries, none, 10).collect() == []


def test_long_lists_are_split_and_whole(frames):
    docs, _ = frames
    rows = postings(doc_tokens(docs))
    lists = inverted_index(rows, max_list=10).collect()
    assert max(r["n_parts"] for r in lists if r["term"] == "the") > 1
    assert all(r["postings"] == sorted(r["postings"]) for r in lists)
    got = {(p["docid"], r["term"]): p["tf"] for r in lists for p in r["postings"]}
    assert got == {(r["docid"], r["term"]): r["tf"] for r in rows.collect()}


def test_copies_of_an_id(spark):
    rows = [("a", f"f{i % 5}", f"t{i}") for i in range(300)] + [("b", "f0", "x")]
    docs = spark.createDataFrame(rows, "docid string, file string, title string")
    last = dedupe_by_id(docs, order=["file"]).collect()
    assert sorted(tuple(r) for r in last) == [("a", "f4", "t99"), ("b", "f0", "x")]
    first = dedupe_by_id(docs, order=["file"], keep="first").collect()
    assert sorted(tuple(r) for r in first) == [("a", "f0", "t0"), ("b", "f0", "x")]
    with pytest.raises(ValueError):
        dedupe_by_id(docs, keep="any")


def test_judged_corpus_keeps_columns(spark, frames):
    docs, _ = frames
    qrels = spark.createDataFrame([("q", "d001"), ("q2", "d001")], "qid string, docid string")
    kept = judged_corpus(docs, qrels)
    assert kept.columns == docs.columns and kept.count() == 1


def partitions_of_documents(run):
    plan = run._jdf.queryExecution().executedPlan().toString()
    return [int(n) for n in re.findall(r"hashpartitioning\(docid#\d+, dl#\d+, (\d+)\), REPARTITION_BY_NUM", plan)]


def test_scores_are_dealt_over_tasks_by_their_number(frames, monkeypatch):
    """60 documents and 4 queries: 240 scores at most, 10 of them a task, whatever the corpus measures in bytes."""
    docs, queries = frames
    monkeypatch.setattr(lexical, "TASK_SUMS", 10, raising=False)
    for run in (bm25_search(queries, docs, 200), lexical.search(build_index(docs), queries, 200)):
        assert partitions_of_documents(run) and set(partitions_of_documents(run)) == {24}
        assert ordered(run) == brute_bm25(QUERIES, DOCS, 200)


def test_a_joined_word_meets_its_queries_in_parts(frames, monkeypatch):
    """No task has all documents of a frequent word, neither when the vocabulary is joined nor when its weights are."""
    docs, queries = frames
    for name, value in {"TASK_SUMS": 10, "TASK_ROWS": 20, "TASK_DOCS": 16}.items():
        monkeypatch.setattr(lexical, name, value, raising=False)
    split = []
    heavy = lexical.split_heavy
    monkeypatch.setattr(lexical, "split_heavy", lambda *a: split.append(heavy(*a).cache()) or split[-1])
    run = bm25_search(queries, docs, 200, broadcast_bytes=0)
    assert ordered(run) == brute_bm25(QUERIES, DOCS, 200) and set(partitions_of_documents(run)) == {24}
    sizes = split[0].filter("term = 'the'").groupBy("part").count().collect()
    assert len(sizes) > 4 and sum(r["count"] for r in sizes) == 45
    monkeypatch.setattr(lexical, "fits_broadcast", lambda *a: False)
    assert ordered(lexical.search(build_index(docs), queries, 200)) == brute_bm25(QUERIES, DOCS, 200)


def test_lists_are_gathered_from_rows_and_counted_once(frames, monkeypatch):
    docs, _ = frames
    monkeypatch.setattr(lexical, "TASK_ROWS", 20, raising=False)
    rows = postings(doc_tokens(docs))
    plan = inverted_index(rows, max_list=10)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan
    dealt = re.search(r"hashpartitioning\(term#\d+, part#\d+, (\d+)\), REPARTITION_BY_NUM", plan)
    assert int(dealt.group(1)) >= rows.count() / 20 and plan.count("hashpartitioning(term") == 1


def test_bounded_search_reads_only_postings_of_its_words(frames, monkeypatch):
    docs, queries = frames
    index, kept, plain = build_index(docs), [], lexical.stored
    monkeypatch.setattr(lexical, "stored", lambda df: kept.append(plain(df)) or kept[-1])
    assert ordered(lexical.bounded_search(index, queries, 5)) == brute_bm25(QUERIES, DOCS, 5)
    words = {w.lower() for q in QUERIES.values() for w in q.split()}
    assert {r["term"] for r in kept[0].select("term").distinct().collect()} <= words and len(kept) == 1
