"""URL verdicts: host and path rules first, and a logistic regression on hashed character n-grams for the rest."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm.columns import ascii_lower, packed
from rankframe.llm.skew import skew_join

NGRAMS = (3, 4)
FEATURES = 1 << 14
MAX_LABELLED = 20_000
"""Labelled URLs that the classifier is fitted on at most, chosen by the hash of the URL."""

MADE = ("host", "path", "rule", "verdict")

BLOCK_HOSTS = (
    "ads-server ads-tracker track-ads click-track adserver banner-ads adult-video adult-chat xxx-adult porn-tube live-sex "
    "casino-bonus online-casino casino-club poker-win slots-win free-bets-now sport-bets bets-online cheap-pills-shop pills-online "
    "buy-pills viagra-cheap spam-mail spam-links link-farm content-farm free-money win-prize malware-load"
)
ALLOW_HOSTS = (
    "news daily-news city-news weather science physics history library museum gallery garden cooking recipes travel guide maps "
    "school college university research journal archive books poems music radio theatre sports health clinic hospital council "
    "parliament courts market farmers bakery railway airport harbour river mountain forest wildlife astronomy geology"
)
LABELLED_PATHS = ("/", "/en/17", "/de/204.html", "/fr/31/", "/es/5082")
"""The small labelled table that the classifier is trained from by default: each name below a few domains, with the
same paths on both sides, so that the hosts decide."""


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The default labelled table: (url, verdict)."""
    names = [(name, "block") for name in BLOCK_HOSTS.split()] + [(name, "allow") for name in ALLOW_HOSTS.split()]
    heads = F.array(*[F.lit(p) for p in ("", "www.", "blog.", "m.")])
    tails = F.array(*[F.lit(p) for p in (".example", ".test", ".invalid")])
    rows = spark.sql("select * from values " + ", ".join(f"('{name}', '{verdict}')" for name, verdict in names) + " as v(name, verdict)")
    paths = F.array(*[F.lit(p) for p in LABELLED_PATHS])
    rows = rows.withColumn("head", F.explode(heads)).withColumn("tail", F.explode(tails)).withColumn("path", F.explode(paths))
    return rows.select(F.concat(F.lit("http://"), "head", "name", "tail", "path").alias("url"), "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased. Path: from there up to
    ``?``, ``#`` or the end. Both are empty for a null url or one without ``://``."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules (rule, verdict), a rule being a host and the path from its first slash on, split into columns."""
    at = F.instr("rule", "/")
    return rules.select(
        "rule",
        "verdict",
        ascii_lower(F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule"))).alias("rule_host"),
        F.when(at > 0, F.substring("rule", at, F.char_length("rule"))).otherwise("").alias("rule_path"),
    )


def with_rule(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``df`` (host, path, ...) with the longest rule that fits as ``fit``, a struct (rule, verdict) or null.

    Each distinct host meets the rules once, by all its parent domains; pages then meet only hosts that have rules.
    """
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = df.select("host").distinct().select("host", F.explode(parents).alias("rule_host"))
    found = (
        hosts.join(rule_table(rules), "rule_host")
        .groupBy("host")
        .agg(F.sort_array(F.collect_set(F.struct(F.char_length("rule").alias("size"), "rule", "rule_path", "verdict")), asc=False).alias("found"))
    )
    fit = F.get(F.filter("found", lambda r: F.startswith(F.col("path"), r["rule_path"])), F.lit(0))
    return skew_join(df, found, ["host"], "left").withColumn(
        "fit", F.when(fit.isNotNull(), F.struct(fit["rule"].alias("rule"), fit["verdict"].alias("verdict")))
    ).drop("found")


def with_features(df: DataFrame) -> DataFrame:
    """``df`` (host, path) with ``features``: counts of hashed character n-grams of ``^host$`` and ``^path$``."""

    def grams(text: Column, part: str, n: int) -> Column:
        last = F.char_length(text) - (n - 1)
        places = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda at: F.concat(F.lit(part), F.substring(text, at, F.lit(n))))

    ends = {part: F.concat(F.lit("^"), F.col(name), F.lit("$")) for part, name in (("h:", "host"), ("p:", "path"))}
    all_grams = F.concat(*[grams(text, part, n) for part, text in ends.items() for n in NGRAMS])
    return HashingTF(numFeatures=FEATURES, inputCol="_grams", outputCol="features").transform(df.withColumn("_grams", all_grams)).drop("_grams")


class Classifier:
    """Block or allow by a fitted model, or always the one label that the training rows have (allow without any)."""

    def __init__(self, labelled: DataFrame, max_labelled: int = MAX_LABELLED):
        """``labelled``: (host, path, verdict). At most ``max_labelled`` distinct rows are used, so one fit is a
        bounded piece of work however long the table is."""
        rows = labelled.select("host", "path", "verdict").dropna().distinct()
        rows = rows.orderBy(F.xxhash64("host", "path"), "host", "path", "verdict").limit(max_labelled)
        rows = with_features(rows).select("features", (F.col("verdict") == "block").cast("double").alias("label")).repartition(1).cache()
        seen = {bool(r["label"]) for r in rows.select("label").distinct().collect()}
        self._model = LogisticRegression(maxIter=50, regParam=0.001).fit(rows) if len(seen) == 2 else None
        self._only = "block" if seen == {True} else "allow"
        rows.unpersist()

    def judge(self, df: DataFrame, name: str = "judged") -> DataFrame:
        if self._model is None:
            return df.withColumns({name: F.lit(self._only), "block_score": F.lit(float(self._only == "block"))})
        scored = self._model.setProbabilityCol("_probability").setPredictionCol("").setRawPredictionCol("").transform(with_features(df))
        score = F.get(vector_to_array("_probability"), F.lit(1))
        return scored.withColumn("block_score", score).withColumn(name, F.when(F.col("block_score") > 0.5, "block").otherwise("allow")).drop("features", "_probability")


def judge(df: DataFrame, rules: DataFrame, labelled: DataFrame | None = None, url: str = "url") -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule`` (the longest that fits, else null), ``verdict`` (the rule's, else the
    classifier's) and ``block_score``; columns of those names are replaced.

    ``labelled`` has (url, verdict), by default ``labelled_urls``. An empty or null url has no host and path and is judged by the classifier like any other.
    """
    given = df.drop(*MADE, "block_score")
    host, path = host_and_path(F.col(f"`{url}`"))
    parts = given.select(packed(given).alias("_row"), host.alias("host"), path.alias("path"))
    ruled = with_rule(parts, rules)
    host, path = host_and_path(F.col("url"))
    known = (labelled or labelled_urls(df.sparkSession)).select(host.alias("host"), path.alias("path"), "verdict")
    judged = Classifier(known).judge(ruled)
    return judged.select(
        "_row.*", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "judged").alias("verdict"), "block_score"
    )
