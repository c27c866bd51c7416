"""The checked queries in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from checks.spark import NOISE
from checks.tables import RUN_K

LINE = "chr(10)"
# Unicode white space, spelled out here so that the SQL does not share the engine's idea of it.
CODES = (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
WHITESPACE = "".join(map(chr, CODES))
WHITESPACE_RUN = "[" + "".join(f"\\x{{{code:x}}}" for code in CODES) + "]+"
CORPUS = f"""
corpus as (
  select doc_id docid, split_part(text, {LINE}, 1) title,
    substr(text, length(split_part(text, {LINE}, 1)) + 2) abstract, lang snapshot
  from documents)"""
QUERIES = "queries as (select item_id qid, text query from benchmark)"
QRELS = """
qrels as (
  select doc_id % (select count(*) from benchmark) qid, doc_id docid, quality * (2 - toxic) relevance
  from labels)"""
VECTORS = """
vectors as (select vec_id docid, embedding::double[] v from embeddings),
query_vectors as (
  select item_id qid, embedding::double[] v from benchmark join embeddings on vec_id = item_id)"""
COPIES = """
copies as (
  select docid, title, abstract, 1 seq from corpus union all
  select docid, 'copy ' || title, abstract, 2 from corpus where docid in (select doc_id from labels))"""


def strip(text: str) -> str:
    return f"trim({text}, '{WHITESPACE}')"


def words(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), '{WHITESPACE_RUN}'), lambda t: t <> '')"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(part.strip() for part in parts)


SHORT_QUERIES = f"queries as (select item_id qid, array_to_string({words('text')}[-2:], ' ') query from benchmark)"
TEXT = "title || ' ' || abstract"
TEXTS = f"""
texts as (select docid, {strip(TEXT)} as text from corpus where {strip(TEXT)} <> '')"""
TOKENS = f"tokens as (select docid, {words(TEXT)} w from corpus)"
JUDGED_TOKENS = f"tokens as (select docid, {words(TEXT)} w from corpus where docid in (select docid from qrels))"
POSTINGS = """
words as (select docid, len(w) dl, unnest(w) term from tokens),
postings as (select docid, term, count(*) tf, max(dl) dl from words group by all)"""


def bm25(name: str, k: int) -> str:
    """Run of ``queries`` over ``postings`` and ``tokens``."""
    return f"""
{name}_stats as (select count(*) n, sum(len(w)) / count(*) avgdl from tokens),
{name}_df as (select term, count(*) df from postings group by all),
{name}_terms as (
  select qid, term, count(*) qtf from (select qid, unnest({words("query")}) term from queries) group by all),
{name}_scores as (
  select qid, docid, round(sum(
    qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) score
  from {name}_terms join postings using (term) join {name}_df using (term), {name}_stats group by all),
{name} as ({ranked(f"{name}_scores", "score", k)})"""


def ranked(source: str, score: str, k: int | None = None, by: str = "qid") -> str:
    cut = f" qualify rank <= {k}" if k else ""
    return f"""
  select *, row_number() over (partition by {by} order by {score} desc, docid)::int as "rank"
  from {source}{cut}"""


def dense(name: str, k: int, weighted: bool = False, tie: str = "docid") -> str:
    q, d = (f"list_transform({v}, lambda x, i: x * [1, 2, 4][(i - 1) % 3 + 1])" if weighted else v for v in ("q.v", "d.v"))
    return f"""
{name} as (
  select qid, docid, round(list_cosine_similarity({q}, {d}), 12) score,
    row_number() over (partition by qid order by round(list_cosine_similarity({q}, {d}), 12) desc, {tie})::int
      as "rank"
  from query_vectors q cross join vectors d qualify rank <= {k})"""


EXPERTS = ",\n".join(
    part.strip()
    for part in (
        CORPUS,
        QUERIES,
        QRELS,
        VECTORS,
        JUDGED_TOKENS,
        POSTINGS,
        dense("run_a", RUN_K),
        dense("run_b", RUN_K, weighted=True),
        bm25("run_c", RUN_K),
    )
)


def fused(weights: tuple[float, float, float]) -> str:
    a, b, c = weights
    scores = f"""
fused_scores as (
  select qid, docid, round(
    coalesce(a.score, 0.0) * {a} + coalesce(b.score, 0.0) * {b} + coalesce(c.score, 0.0) * {c}, 10) fused_score
  from run_a a full join run_b b using (qid, docid) full join run_c c using (qid, docid))"""
    return f"with {EXPERTS},\n{scores},\nfused as ({ranked('fused_scores', 'fused_score')})" + (
        ' select qid, docid, round(fused_score + 5e-13, 6) fused_score, "rank" from fused'
    )


RRF = f"""
rrf_scores as (
  select qid, docid, round(sum(1 / ("rank" + 60)), 12) rrf_score
  from (select qid, docid, "rank" from run_a union all select qid, docid, "rank" from run_b
        union all select qid, docid, "rank" from run_c)
  group by all),
rrf_run as ({ranked("rrf_scores", "rrf_score")})"""

JACCARD = f"""
  select qid, docid, round(coalesce(
    len(list_intersect(list_distinct({words("query")}), list_distinct({words("coalesce(text, '')")})))
    / nullif(len(list_distinct(list_concat({words("query")}, {words("coalesce(text, '')")}))), 0), 0), 15) score"""


def reranked(run: str, docs: str, how: str) -> str:
    return f"""
{run}_scores as ({JACCARD}
  from {run} {how} join {docs} using (docid) join queries using (qid)),
reranked as ({ranked(f"{run}_scores", "score")})"""


SPARSE = "sparse as (select qid, docid * 3 docid, \"rank\" from run)"
SHOWN = ' select qid, docid, round(score + 5e-13, 6) score, "rank" from '


def rerank(how: str) -> str:
    return (
        with_(CORPUS, QUERIES, VECTORS, TEXTS, dense("run", RUN_K), SPARSE, reranked("sparse", "texts", how))
        + f"{SHOWN}reranked"
    )


def ndcg(run: str, judged: str = "qrels", score: str = "score") -> str:
    """``ndcg(qid, dcg, idcg, ndcg)``: all depths, ties averaged, queries without a relevant hit left out."""
    return f"""
judged as (
  select r.qid, r.docid, {score} s, coalesce(relevance, 0) rel
  from {run} r left join {judged} j on r.qid = j.qid and r.docid = j.docid),
placed as (
  select *, 1 / log2(1 + row_number() over (partition by qid order by s desc, docid)) discount,
    1 / log2(1 + row_number() over (partition by qid order by rel desc)) ideal
  from judged),
shared as (select *, avg(discount) over (partition by qid, s) tied from placed),
ndcg as (
  select qid, sum(rel * tied) dcg, sum(rel * ideal) idcg, sum(rel * tied) / sum(rel * ideal) ndcg
  from shared group by qid having sum(rel) > 0)"""


SIX = "select qid, round(dcg + 5e-13, 6) dcg, round(idcg + 5e-13, 6) idcg, round(ndcg + 5e-13, 6) ndcg from ndcg"
MEAN = "select round(coalesce(avg(ndcg), 0) + 5e-13, 6) ndcg, count(*) n_queries from ndcg"
BM25_JUDGED = (CORPUS, QUERIES, QRELS, JUDGED_TOKENS, POSTINGS, bm25("run", 200))

PAIRS = f"""
pairs as (
  select qid, docid, 'query: ' || {strip("query")} query_text, 'passage: ' || text passage_text
  from qrels join queries using (qid) join texts using (docid) where relevance > 0)"""

SNAPSHOT_RUN = f"""
near as (
  select d.snapshot, q.qid, v.docid, round(list_cosine_similarity(q.v, v.v), 12) score
  from query_vectors q join corpus h on h.docid = q.qid join corpus d on d.snapshot = h.snapshot
    join vectors v on v.docid = d.docid
  qualify row_number() over (partition by d.snapshot, q.qid order by score desc, v.docid) <= 100),
candidates as (
  select n.snapshot, n.qid, n.docid, lower({strip("query")}) query, {TEXT} as text
  from near n join corpus c using (docid) join queries q using (qid)),
scores as ({JACCARD.replace("select qid", "select snapshot, qid")} from candidates),
run as ({ranked("scores", "score", by="snapshot, qid")})"""

SNAPSHOT_DENSE = """
dense_run as (
  select c.snapshot, q.qid, d.docid, round(list_cosine_similarity(q.v, d.v), 12) score,
    row_number() over (partition by c.snapshot, q.qid order by round(list_cosine_similarity(q.v, d.v), 12) desc, d.docid)
      ::int as "rank"
  from query_vectors q cross join vectors d join corpus c on c.docid = d.docid qualify "rank" <= 100)"""

COUNTED = (
    with_(CORPUS, TEXTS) + f" select docid, length(text) chars, len({words('text')}) words from texts"
)

ORACLE = {
    "text_assembly": with_(CORPUS)
    + f"""
select docid, {strip(TEXT)} = '' blank, md5(lower({TEXT})) bm25_text, md5(lower({strip(TEXT)})) encode_text,
  md5('passage: ' || lower({strip(TEXT)})) passage_text, md5('passage: ' || {strip(TEXT)}) training_text,
  md5({strip(TEXT)}) rerank_text, md5({TEXT}) raw_text from corpus""",
    "text_guard": with_(CORPUS)
    + """
select docid::varchar docid, md5(lower(case when snapshot in ('de', 'fr', 'es') then '' else title end
  || ' ' || abstract)) bm25_text from corpus""",
    "query_normalize": with_(QUERIES)
    + f"""
select qid, 'query: ' || lower({strip("query")}) prefix_lower, {strip("query")} strip, query raw,
  'query: ' || {strip("query")} prefix,
  replace('query: ' || lower({strip("query")}), 'query: ', '') bare from queries""",
    "dedupe_last_wins": with_(CORPUS, COPIES)
    + """
select docid, seq, title from copies
qualify row_number() over (partition by docid order by seq desc) = 1""",
    "dedupe_first_wins": with_(CORPUS, COPIES)
    + """
select docid, seq, title from copies
qualify row_number() over (partition by docid order by seq) = 1""",
    "judged_corpus": with_(CORPUS, QRELS)
    + " select docid, title from corpus where docid in (select docid from qrels)",
    "available_qrels": with_(QRELS, VECTORS)
    + " select qid, docid, relevance from qrels where docid in (select docid from vectors)",
    "positive_qrels": with_(QRELS) + " select qid, docid, relevance from qrels where relevance > 0",
    "judged_plus_noise": with_(CORPUS, QRELS)
    + f""",
noise as (
  select docid from corpus where docid not in (select docid from qrels)
  order by md5('7|' || docid), docid limit {NOISE})
select docid, title from corpus
where docid in (select docid from qrels) or docid in (select docid from noise)""",
    "tokens": with_(CORPUS, TOKENS)
    + " select docid, len(w)::int dl, md5(coalesce(array_to_string(w, ' '), '')) words from tokens",
    "postings": with_(CORPUS, TOKENS, POSTINGS) + " select docid, term, tf, dl::int dl from postings",
    "doc_freq": with_(CORPUS, TOKENS, POSTINGS) + " select term, count(*) df from postings group by all",
    "doc_lengths": with_(CORPUS, TOKENS) + " select docid, len(w)::int dl from tokens",
    "corpus_stats": with_(CORPUS, TOKENS)
    + """
select count(*) n, sum(len(w))::bigint total, round(sum(len(w)) / count(*), 6) avgdl from tokens""",
    "inverted_index": with_(CORPUS, TOKENS, POSTINGS)
    + """,
parts as (select term, greatest(ceil(count(*) / 256), 1)::int n_parts from postings group by all)
select term, part, n_parts, string_agg(docid || ':' || tf, ',' order by docid) postings
from (select *, (('0x' || substr(md5(docid::varchar), 1, 8))::bigint % n_parts)::int part
      from postings join parts using (term))
group by all""",
    "bm25_topk": with_(*BM25_JUDGED) + f"{SHOWN}run",
    "bm25_whole_corpus": with_(CORPUS, QUERIES, TOKENS, POSTINGS, bm25("run", 200))
    + f"{SHOWN}run",
    "bm25_large_vocabulary": with_(CORPUS, QUERIES, TOKENS, POSTINGS, bm25("run", 20)) + f"{SHOWN}run",
    "search_bounded": with_(CORPUS, SHORT_QUERIES, TOKENS, POSTINGS, bm25("run", 10)) + f"{SHOWN}run",
    "search_top10": with_(CORPUS, QUERIES, TOKENS, POSTINGS, bm25("run", 10))
    + f"{SHOWN}run",
    "dense_topk": with_(VECTORS, dense("run", 200)) + f"{SHOWN}run",
    "dense_pruned": with_(VECTORS, dense("run", 200)) + f"{SHOWN}run",
    "dense_topk_deep": with_(VECTORS, dense("run", 1500)) + f"{SHOWN}run",
    "dense_topk_blocked": with_(VECTORS, dense("run", 100, tie="docid desc")) + f"{SHOWN}run",
    "zero_based_rank": with_(VECTORS, dense("run", RUN_K))
    + ' select qid, docid, round(score + 5e-13, 6) score, ("rank" - 1)::int as "rank" from run',
    "weighted_fusion": fused((0.8, 0.1, 0.1)),
    "weighted_fusion_default": fused((0.4, 0.4, 0.2)),
    "rrf": f"with {EXPERTS},\n{RRF} from rrf_run",
    "rrf_derive_rank": f"with {EXPERTS},\n{RRF} from rrf_run",
    "rerank_drop": rerank("inner"),
    "rerank_blank": rerank("left"),
    "rerank_from_embeddings": with_(
        CORPUS, QUERIES, VECTORS, TEXTS, dense("run", RUN_K, tie="docid desc"), reranked("run", "texts", "left")
    )
    + f"{SHOWN}reranked",
    "ndcg_per_query": with_(*BM25_JUDGED, ndcg("run")) + f" {SIX}",
    "ndcg_mean": with_(*BM25_JUDGED, ndcg("run")) + f" {MEAN}",
    "ndcg_constant_score": with_(
        QRELS,
        VECTORS,
        "available as (select * from qrels where docid in (select docid from vectors))",
        dense("run", RUN_K),
        ndcg("run", "available", "1"),
    )
    + f" {SIX}",
    "ndcg_at_k_standard": with_(*BM25_JUDGED)
    + """,
judged as (
  select r.qid, r.docid, score s, coalesce(relevance, 0) rel
  from run r left join qrels j on r.qid = j.qid and r.docid = j.docid),
placed as (
  select *, row_number() over (partition by qid order by s desc, docid) pos from judged),
shared as (
  select *, avg(case when pos <= 10 then 1 / log2(1 + pos) else 0 end) over (partition by qid, s) tied from placed),
got as (select qid, sum(rel * tied) dcg from shared group by qid),
best as (
  select qid, sum(relevance / log2(1 + pos)) idcg
  from (select *, row_number() over (partition by qid order by relevance desc) pos from qrels where relevance > 0)
  where pos <= 10 group by qid)
select qid, round(coalesce(dcg, 0) + 5e-13, 6) dcg, round(idcg + 5e-13, 6) idcg, round(coalesce(dcg, 0) / idcg + 5e-13, 6) ndcg
from best left join got using (qid)""",
    "qrels_map": with_(QRELS)
    + """
select qid, string_agg(docid || ':' || relevance, ',' order by docid) judgments from qrels group by all""",
    "coverage": with_(CORPUS, QRELS, VECTORS, TEXTS, dense("run", RUN_K), SPARSE)
    + """
select (select count(distinct docid) from qrels) judged_docs,
  (select count(distinct docid) from qrels where docid in (select docid from texts)) judged_docs_found,
  (select count(*) from qrels where docid in (select docid from texts)) qrels_kept,
  (select count(*) from sparse where docid in (select docid from texts)) pairs_prepared,
  (select count(*) from sparse where docid not in (select docid from texts)) pairs_missing""",
    "training_pairs": with_(CORPUS, QUERIES, QRELS, TEXTS, PAIRS) + " from pairs",
    "training_batches": with_(CORPUS, QUERIES, QRELS, TEXTS, PAIRS)
    + """,
placed as (
  select qid, docid, row_number() over (order by md5('3|' || qid || '|' || docid), qid, docid) - 1 as "position"
  from pairs),
batched as (select *, "position" // 8 batch from placed)
select "position", batch, qid, docid, coalesce((
  select string_agg(o.docid, ',' order by o."position") from batched o
  where o.batch = b.batch and o."position" <> b."position"), '') negatives
from batched b""",
    "trec_lines": with_(*BM25_JUDGED)
    + """
select qid || ' Q0 ' || docid || ' ' || "rank" || ' ' || round(score + 5e-13, 6)::decimal(38, 6) || ' bm25' as value from run""",
    "indexable_docs": with_(CORPUS)
    + f" select to_json({{'id': docid, 'contents': {TEXT}}})::varchar as value from corpus",
    "snapshot_runs": with_(CORPUS, QUERIES, VECTORS)
    + f",\n{SNAPSHOT_RUN}"
    + ' select snapshot, qid, docid, round(score + 5e-13, 6) score, "rank" from run',
    "dense_near_ties": with_(
        """vectors as (
  select vec_id docid, embedding::double[] v from embeddings union all
  select vec_id + 1000000, list_transform(embedding::double[], lambda x, i:
    case when i = 1 then x + 1e-8 * (1 + vec_id % 7) else x end) from embeddings),
query_vectors as (select item_id qid, embedding::double[] v from benchmark join embeddings on vec_id = item_id)""",
        dense("run", 20),
    )
    + ' select qid, docid, "rank" from run',
    "dense_grid": with_(VECTORS, dense("run", 100)) + f"{SHOWN}run",
    "weighted_fusion_repeats": fused((0.4, 0.4, 0.2)),
    "rerank_small_scores": with_(
        CORPUS, QUERIES, VECTORS, TEXTS, dense("run", RUN_K), reranked("run", "texts", "inner")
    )
    + ' select qid, docid, "rank" from reranked',
    "qrels_last_wins": with_(QRELS) + " select qid, docid, greatest(relevance - 1, 0) relevance from qrels",
    "snapshot_ndcg": with_(
        CORPUS, QRELS, VECTORS, SNAPSHOT_DENSE, "placed_qrels as (select * from qrels join corpus using (docid))"
    )
    + """,
judged as (
  select r.snapshot, r.qid, r.docid, score s, coalesce(relevance, 0) rel
  from dense_run r left join placed_qrels j on r.qid = j.qid and r.docid = j.docid and r.snapshot = j.snapshot),
placed as (
  select *, 1 / log2(1 + row_number() over (partition by snapshot, qid order by s desc, docid)) discount,
    1 / log2(1 + row_number() over (partition by snapshot, qid order by rel desc)) ideal from judged),
shared as (select *, avg(discount) over (partition by snapshot, qid, s) tied from placed)
select snapshot, qid, round(sum(rel * tied) + 5e-13, 6) dcg, round(sum(rel * ideal) + 5e-13, 6) idcg,
  round(sum(rel * tied) / sum(rel * ideal) + 5e-13, 6) ndcg
from shared group by all having sum(rel) > 0""",
    "snapshot_rrf": with_(CORPUS, VECTORS, SNAPSHOT_DENSE)
    + f""",
rrf_scores as (
  select snapshot, qid, docid, round(sum(1 / (r + 60)), 12) rrf_score
  from (select snapshot, qid, docid, "rank" r from dense_run union all
        select snapshot, qid, docid, 101 - "rank" from dense_run) group by all)
{ranked("rrf_scores", "rrf_score", by="snapshot, qid")}""",
    "snapshot_shared_queries": with_(CORPUS)
    + """
select snapshot, item_id::varchar qid, replace(text, chr(10), ' ') query
from benchmark, (select distinct snapshot from corpus)""",
    "hybrid_pipeline": f"with {EXPERTS},\n{RRF},\n{TEXTS},\n{reranked('rrf_run', 'texts', 'inner')}"
    + f"{SHOWN}reranked",
    "hybrid_ndcg": f"with {EXPERTS},\n{RRF},\n{TEXTS},\n{reranked('rrf_run', 'texts', 'inner')},"
    + f"{ndcg('reranked')} {MEAN}",
    "encode_documents": COUNTED,
    "embeddings_reused": COUNTED,
    "embeddings_changed": with_(CORPUS, TEXTS)
    + f""" select docid, length(text) + case when docid % 2 = 0 then 9 else 0 end chars,
  len({words('text')}) + case when docid % 2 = 0 then 2 else 0 end words from texts""",
    "rerank_model_hook": with_(CORPUS, QUERIES, VECTORS, dense("run", 20))
    + f""",
scored as (select r.qid, r.docid, (coalesce(length({strip(TEXT)}), 0) - length(query))::double score
  from run r join queries using (qid) left join corpus c using (docid))
select *, row_number() over (partition by qid order by score desc, docid)::int as "rank" from scored""",
    "dense_encoder": with_(
        CORPUS,
        f"vectors as (select docid, [length(title) % 7 + 1, len({words('title')}) % 5, 1]::double[] v from corpus)",
        f"query_vectors as (select item_id qid, [length(text) % 7 + 1, len({words('text')}) % 5, 1]::double[] v from benchmark)",
        dense("run", 20),
    )
    + f"{SHOWN}run",
    "run_order_files": with_(VECTORS, dense("run", RUN_K))
    + """,
placed as (select *, row_number() over (order by qid, score desc, docid) - 1 place from run)
select qid::varchar qid, docid::varchar docid, place, place as "position" from placed""",
    "read_corpus_files": with_(CORPUS)
    + f" select docid::varchar docid, md5(lower({TEXT})) bm25_text from corpus",
    "read_query_files": "select item_id::varchar qid, replace(text, chr(10), ' ') query from benchmark",
    "read_qrels_files": with_(QRELS)
    + " select qid::varchar qid, '0' as iter, docid::varchar docid, relevance from qrels",
    "run_files": with_(VECTORS, dense("run", RUN_K))
    + ' select qid::varchar qid, docid::varchar docid, round(score + 5e-13, 6) score, "rank" from run',
    "trec_files": with_(VECTORS, dense("run", RUN_K))
    + """ select qid::varchar qid, docid::varchar docid, round(score + 5e-13, 6) score, "rank", 'dense' tag from run""",
    "embedding_files": with_(VECTORS)
    + " select docid::varchar docid, len(v)::int dims, round(list_sum(v), 6) total from vectors",
    "index_files": with_(CORPUS, QUERIES, TOKENS, POSTINGS, bm25("run", 10))
    + f"{SHOWN}run",
    "snapshot_files": with_(CORPUS)
    + f""",
queries as (select item_id qid, replace(text, chr(10), ' ') query from benchmark),
asked as (
  select snapshot, qid::varchar qid, lower({strip("query")}) query, 'query: ' || lower({strip("query")}) t
  from queries join corpus on docid = qid),
stored as (
  select snapshot, docid::varchar docid, {TEXT} as text, 'passage: ' || lower({strip(TEXT)}) t
  from corpus where {strip(TEXT)} <> ''),
counted_q as (select *, [length(t), len({words("t")})]::double[] v from asked),
counted_d as (select *, [length(t), len({words("t")})]::double[] v from stored),
near as (
  select q.snapshot, qid, docid, query, text, round(list_cosine_similarity(q.v, d.v), 12) near
  from counted_q q join counted_d d using (snapshot)
  qualify row_number() over (partition by q.snapshot, qid order by near desc, docid) <= 100),
scores as ({JACCARD.replace("select qid", "select snapshot, qid")} from near),
run as ({ranked("scores", "score", by="snapshot, qid")})
select qid, docid, round(score + 5e-13, 6) score, "rank", 'e5-reranked' tag from run""",
}
