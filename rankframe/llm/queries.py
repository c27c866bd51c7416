"""The driver's tables through the operators: one thin query for each, and the same in DuckDB SQL where SQL can."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankframe.functions.ranking import written
from rankframe.llm import byte_bpe, chat, cover_tree, decontaminate, extraction, line_dedup, lm_scoring, near_dup, prefix_trie, quality, sharding, structure_repair, url_filter
from rankframe.llm.oracle import ORACLE as ORACLE
from rankframe.llm.skew import skew_join


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, host="source", keep=("doc_id",))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out.alias("held_out"), "text")
    return lm_scoring.score(docs, ~F.col("held_out"), keep=("doc_id", "held_out"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, keep=("page_id", "url"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("found.spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        covered.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (covered > 0).alias("contaminated"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table and conversation -7, whose texts are control strings, as an event log: one delta for each row."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(
        "select bigint(conv_id) conv_id, bigint(turn) turn, role, '</s>[INST] ok [/INST]' text "
        "from values (-7, 0, 'user'), (-7, 1, 'assistant') as v(conv_id, turn, role)"
    )
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    return rows.unionByName(added).withColumns({"turn": at, "seq": F.col("turn"), "kind": F.lit("delta")})


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = chat.render(chat.fold(conversations(spark, sf_dir)))
    read = rendered.withColumns({"turns": chat.read_back(F.col("formatted")), "learned": chat.learned_text(F.col("formatted"), F.col("loss"))})
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = line_dedup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return made.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.groups(docs, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return sharding.shard(docs, n_shards=8, keep=("doc_id",), dims=("n_chars", "lang", "source")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


RULES = "select * from values ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow') as v(rule, verdict)"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, spark.sql(RULES)).select("page_id", "host", "path", "rule", "verdict", "block_score")


GROUP = 20
"""Conversations of one group of ids take their first turns from the group's first."""


def rebuilt(ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation behind the first h turns of its group's first, in place of its own first h: the turns, and the
    ids of all conversations. ``ids`` are ``prefix_trie.turn_ids``, stored."""
    lead = F.crc32(F.col("conv_id").cast("string")) % 4
    turn = F.struct("pos", "h1", "h2", "words")
    heads = ids.filter((F.col("conv_id") % GROUP == 0) & (F.col("pos") < 3))
    heads = heads.groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(turn)).alias("head"))
    convs = ids.select("conv_id").distinct().withColumn("first", F.col("conv_id") - F.col("conv_id") % GROUP)
    none = F.slice(F.array(F.struct(*[F.lit(0).cast("long").alias(c) for c in ("pos", "h1", "h2", "words")])), 1, 0)
    head = F.slice(F.coalesce("head", none), F.lit(1), lead.cast("int"))
    convs = convs.join(heads, "first", "left").select("conv_id", head.alias("head"))
    taken = convs.select("conv_id", F.explode("head").alias("turn")).select("conv_id", "turn.*")
    own = skew_join(ids.filter(F.col("pos") >= lead), convs.select("conv_id", F.size("head").alias("n_head")), ["conv_id"])
    own = own.select("conv_id", (F.col("pos") - lead + F.col("n_head")).alias("pos"), "h1", "h2", "words")
    return taken.unionByName(own), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = written(prefix_trie.turn_ids(table(spark, sf_dir, "conversations")))
    return prefix_trie.prefix_trie(*rebuilt(ids))


def op12_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = cover_tree.near_groups(vectors, cosine=0.9)
    return found.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with the stated damage by the check sum of ``conv_id:turn``: a row is dropped (``there`` is false), loses
    its text or its sentence ends, stands twice, or becomes a user's. A null counts as one space."""
    known = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    known = known.withColumn("harm", F.crc32(F.concat_ws(":", *named)) % 20)
    harm = F.col("harm")
    text = F.when(harm == 1, "").when(harm == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(harm != 0, F.when(harm == 3, 2).otherwise(1)))
    return known.select("conv_id", "turn", F.when(harm == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("there"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return structure_repair.repair(rows, F.col("there")).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_main_text": op3_main_text,
    "op4_decontaminate": op4_decontaminate,
    "op5_chat_format": op5_chat_format,
    "op6_line_dedup": op6_line_dedup,
    "op7_near_dup": op7_near_dup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_kd_sharding": op9_kd_sharding,
    "op10_url_filter": op10_url_filter,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_cover_tree": op12_cover_tree,
    "op13_structure_repair": op13_structure_repair,
}
