from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankframe import assemble_text, build_index, dedupe_by_id, search
from rankframe.operators.lexical import bm25_search
from rankframe.sources.readers import (
    parse_documents,
    read_corpus,
    read_embeddings,
    read_index,
    read_qrels,
    read_queries,
    read_run,
    read_snapshots,
    read_trec_run,
)
from rankframe.sources.writers import (
    global_order,
    to_indexable,
    to_trec_lines,
    write_embeddings,
    write_index,
    write_indexable,
    write_run,
    write_trec_run,
)

DOCS = [
    {"id": 1, "title": "Solar Cells", "abstract": "thin film solar"},
    {"id": "007", "title": None, "abstract": "leading zero id"},
    {"id": 3, "title": ["x"], "abstract": "title is a list"},
    {"id": 4, "title": "", "abstract": "  "},
    {"id": 5},
    {"id": 6, "title": 12, "abstract": "["},
    {"id": 8, "title": "[\"x\"]", "abstract": "null"},
]


@pytest.fixture
def folder(tmp_path):
    docs = tmp_path / "documents"
    docs.mkdir()
    (docs / "a.jsonl").write_text("\n".join(json.dumps(d) for d in DOCS) + "\n")
    (docs / "b.jsonl").write_text(json.dumps({"id": 1, "title": "Solar Cells", "abstract": "second copy"}) + "\n")
    (docs / "notes.txt").write_text("not a document\n")
    (tmp_path / "queries.txt").write_text("q1\tsolar solar film\nq2\tunknownword\nq3\tnull\n007\tNA\n")
    (tmp_path / "qrels.txt").write_text("q1 0 1 2\nq1 0 007 0\nq2 0 3 1\n")
    return tmp_path


def test_corpus_keeps_only_strings(spark, folder, rows):
    docs = dedupe_by_id(read_corpus(spark, str(folder / "documents")), order=["file"])
    assert rows(docs.select("docid", assemble_text())) == sorted(
        [
            ("1", "Solar Cells second copy"),
            ("007", " leading zero id"),
            ("3", " title is a list"),
            ("4", "   "),
            ("5", " "),
            ("6", " ["),
            ("8", "[\"x\"] null"),
        ]
    )


def test_unguarded_refuses_other_types(spark, folder):
    with pytest.raises(Exception, match="title is not a string"):
        read_corpus(spark, str(folder / "documents"), guard=False).collect()
    falsy = spark.createDataFrame([('{"id": 1, "title": [], "abstract": 0}',), ('{"id": 2, "title": false}',)], "value string")
    assert falsy.count() == parse_documents(falsy, guard=False).filter("title is null and abstract is null").count()


def test_malformed_lines(spark):
    lines = spark.createDataFrame([("{\"id\": 1}",), ("{broken",), ("{\"title\": \"no id\"}",)], "value string")
    with pytest.raises(Exception):
        parse_documents(lines).collect()
    kept = parse_documents(lines, mode="PERMISSIVE").filter(F.col("_corrupt_record").isNotNull())
    assert {r["_corrupt_record"] for r in kept.collect()} == {"{broken", "{\"title\": \"no id\"}"}


def test_queries_and_qrels_keep_texts_and_zeros(spark, folder, rows):
    assert rows(read_queries(spark, str(folder / "queries.txt"))) == [
        ("007", "NA"),
        ("q1", "solar solar film"),
        ("q2", "unknownword"),
        ("q3", "null"),
    ]
    assert rows(read_qrels(spark, str(folder / "qrels.txt"))) == [("q1", "0", "007", 0), ("q1", "0", "1", 2), ("q2", "0", "3", 1)]


def test_run_round_trip_and_columns_by_name(spark, tmp_path, rows):
    run = spark.createDataFrame([("007", "01", 0.25, 1), ("007", "1", 0.125, 2)], "qid string, docid string, score double, rank int")
    write_run(run, str(tmp_path / "run"))
    write_run(run, str(tmp_path / "run"))
    assert rows(read_run(spark, str(tmp_path / "run"))) == rows(run)
    (tmp_path / "other.csv").write_text("docid,rank,fused_score,qid\n01,1,0.5,007\n")
    back = read_run(spark, str(tmp_path / "other.csv"))
    assert rows(back, "qid", "docid", "fused_score", "rank") == [("007", "01", 0.5, 1)]
    (tmp_path / "bare.csv").write_text("score,docid,qid\n0.5,01,007\n")
    assert read_run(spark, str(tmp_path / "bare.csv")).columns == ["qid", "docid", "score"]


def test_trec_round_trip_in_order(spark, tmp_path, rows):
    run = spark.createDataFrame(
        [(f"q{q}", f"d{r:02}", 1.0 / r if r < 30 else 0.00001, r) for q in range(5) for r in range(1, 31)],
        "qid string, docid string, score double, rank int",
    )
    write_trec_run(run.orderBy(F.rand(1)), str(tmp_path / "run"), "tag")
    files = sorted((tmp_path / "run").glob("part-*.gz"))
    lines = [line for f in files for line in gzip.decompress(f.read_bytes()).decode().splitlines()]
    assert lines[0] == "q0 Q0 d01 1 1.000000 tag"
    assert lines[29] == "q0 Q0 d30 30 0.000010 tag"
    assert [(p[0], int(p[3])) for p in map(str.split, lines)] == [(f"q{q}", r) for q in range(5) for r in range(1, 31)]
    back = read_trec_run(spark, str(tmp_path / "run"))
    assert rows(back, "qid", "docid", "rank") == rows(run, "qid", "docid", "rank")
    assert {r["tag"] for r in back.collect()} == {"tag"}


def test_embeddings_round_trip(spark, tmp_path, rows):
    stored = spark.createDataFrame([("007", [0.5, 1.0])], "docid string, embedding array<float>")
    write_embeddings(stored, str(tmp_path / "vectors"))
    assert read_embeddings(spark, str(tmp_path / "vectors")).collect() == stored.collect()


def test_indexable(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Big \"T\"", ""), (2, "t", "Ab\n")], "docid long, title string, abstract string")
    write_indexable(docs, str(tmp_path / "out"))
    lines = {r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()}
    assert [json.loads(x) for x in sorted(lines)] == [{"id": 1, "contents": "Big \"T\" "}, {"id": 2, "contents": "t Ab\n"}]
    with pytest.raises(Exception, match="no title"):
        to_indexable(docs.withColumn("title", F.lit(None).cast("string"))).collect()
    with pytest.raises(Exception, match="null abstract in document"):
        to_indexable(docs.withColumn("abstract", F.lit(None).cast("string"))).collect()


def test_run_line_refuses_nulls(spark):
    run = spark.createDataFrame([("q", "d", 1, None)], "qid string, docid string, rank int, score double")
    with pytest.raises(Exception, match="null score in a run"):
        to_trec_lines(run, "t").collect()


def test_shared_queries_belong_to_every_snapshot(spark, tmp_path, rows):
    for name in ("2024-11", "2025-01"):
        folder = tmp_path / "documents" / f"snapshot={name}"
        folder.mkdir(parents=True)
        (folder / "d.jsonl").write_text(json.dumps({"id": name, "title": "t"}))
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries" / "q.txt").write_text("q1\tshared\n")
    _, queries = read_snapshots(spark, str(tmp_path))
    assert rows(queries, "snapshot", "qid") == [("2024-11", "q1"), ("2025-01", "q1")]
    _, queries = read_snapshots(spark, str(tmp_path), skip=["2024-11"])
    assert rows(queries, "snapshot", "qid") == [("2025-01", "q1")]


def test_snapshots_keep_their_names(spark, tmp_path, rows):
    for name in ("2024-11", "2025-01"):
        for kind, file, text in (
            ("documents", "d.jsonl", json.dumps({"id": name, "title": "t"})),
            ("queries", "q.tsv", f"q\tquery of {name}"),
        ):
            place = tmp_path / kind / f"snapshot={name}"
            place.mkdir(parents=True)
            (place / file).write_text(text + "\n")
    docs, queries = read_snapshots(spark, str(tmp_path))
    assert rows(docs, "docid", "snapshot") == [("2024-11", "2024-11"), ("2025-01", "2025-01")]
    assert rows(queries, "qid", "query", "snapshot") == [
        ("q", "query of 2024-11", "2024-11"),
        ("q", "query of 2025-01", "2025-01"),
    ]


def test_one_dataset_is_one_snapshot(spark, tmp_path, rows):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents" / "d.jsonl").write_text('{"id": 1}\n')
    (tmp_path / "queries").mkdir()
    (tmp_path / "queries" / "q.tsv").write_text("q\tx\n")
    docs, queries = read_snapshots(spark, str(tmp_path), snapshot="only")
    assert rows(docs, "snapshot") == rows(queries, "snapshot") == [("only",)]


def test_stored_index_searches_like_the_documents(spark, tmp_path, rows):
    docs = spark.createDataFrame(
        [(f"d{i:02}", f"it's w{i % 3} \\back", f"w{i % 7} common " * (1 + i % 4)) for i in range(40)] + [("empty", None, None)],
        "docid string, title string, abstract string",
    )
    queries = spark.createDataFrame([("a", "it's common w1"), ("b", "w5 w5 \\back"), ("c", "none")], "qid string, query string")
    write_index(build_index(docs), str(tmp_path / "index"))
    index = read_index(spark, str(tmp_path / "index"))
    assert index.stats.first()["n"] == 41
    found = search(index, queries, 12)
    assert rows(found) == rows(bm25_search(queries, docs, 12))
    assert found.select("qid").distinct().count() == 2


def test_global_order(spark):
    run = spark.createDataFrame([("b", "1", 0.1), ("a", "2", 0.5), ("a", "1", 0.5), ("a", "3", 0.9)], "qid string, docid string, score double")
    assert [(r["qid"], r["docid"]) for r in global_order(run).collect()] == [("a", "3"), ("a", "1"), ("a", "2"), ("b", "1")]
