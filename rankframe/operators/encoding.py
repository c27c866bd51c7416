"""Hooks for models the user brings: text to vector, (query, text) to score."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankframe.functions.ranking import shuffle_partitions, written
from rankframe.functions.sizing import broadcast_if_small

Predict = Callable[..., np.ndarray]


def model_encoder(load: Callable[[], Predict], batch_size: int = 64) -> Callable[[Column], Column]:
    """``load`` runs once per Python worker and returns ``texts -> matrix``."""
    return predict_batch_udf(load, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size)


def model_scorer(load: Callable[[], Predict], batch_size: int = 32) -> Callable[[Column, Column], Column]:
    """``load`` runs once per Python worker and returns ``(queries, texts) -> scores``."""
    return predict_batch_udf(load, return_type=T.DoubleType(), batch_size=batch_size)


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def encode(
    df: DataFrame, encoder: Callable[[Column], Column], text: str = "text", key: str | Sequence[str] = "docid"
) -> DataFrame:
    return df.select(*_keys(key), encoder(F.col(text)).alias("embedding"))


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    try:
        return df.sparkSession.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


FINGERPRINT = "fingerprint"


def fingerprint(*texts: Column) -> Column:
    """Digest of texts, of which none runs into the next."""
    parts = [part for text in texts for part in (F.octet_length(text).cast("string"), F.lit(":"), text)]
    return F.md5(F.concat(*parts))


def embeddings_or_compute(
    df: DataFrame,
    path: str,
    encoder: Callable[[Column], Column],
    text: str = "text",
    key: str | Sequence[str] = "docid",
    partition: str | None = None,
) -> DataFrame:
    """Vectors of ``df``'s documents, encoding and storing only those that ``path`` does not hold yet for this id and this
    text. A vector lies beside the fingerprint of its text: where a text has changed, the old vector stays in the store
    and out of the result, and so do vectors of ids that are no longer in ``df``. Vectors without a fingerprint, and null
    texts' ones, are of unknown text and are made anew. A column ``partition`` of the key names the store's folders; then
    only the folders of ``df``'s values are read.

    Ids and fingerprints alone are compared; the texts that are missing are then picked where they lie. A run that is cut
    short leaves what it committed; the next one goes on from there.
    """
    keys = [*_keys(key), FINGERPRINT]
    marked = df.withColumn(FINGERPRINT, fingerprint(F.col(text)))
    stored = _stored(df, path)
    if partition and stored is not None:
        present = [row[0] for row in df.select(partition).distinct().collect()]
        stored = stored.withColumn(partition, F.col(partition).cast(df.schema[partition].dataType))
        stored = stored.filter(F.col(partition).isin(present))
    missing = marked
    if stored is not None and FINGERPRINT in stored.columns:
        names = written(marked.select(*keys).join(stored.select(*keys), keys, "left_anti"))
        missing = marked.join(broadcast_if_small(names), keys, "left_semi")
    new = missing.select(*keys, encoder(F.col(text)).alias("embedding")).write.mode("append")
    (new.partitionBy(partition) if partition else new).parquet(path)
    vectors = df.sparkSession.read.option("mergeSchema", True).parquet(path)
    now = marked.select(*keys).distinct()
    return vectors.dropDuplicates(keys).join(now, keys, "left_semi").select(*_keys(key), "embedding")


def scores_or_compute(pairs: DataFrame, path: str, scorer: Callable[[Column, Column], Column]) -> DataFrame:
    """``pairs`` (…, query, text) with ``score`` in place of the texts. Every distinct pair of texts is scored once, kept
    under ``path`` by its fingerprint, and joined back to all rows that hold it; what the store has is not scored again,
    in this run or a later one."""
    rest = [c for c in pairs.columns if c not in ("query", "text")]
    marked = pairs.withColumn(FINGERPRINT, fingerprint(F.col("query"), F.col("text")))
    named = written(marked.select(*rest, FINGERPRINT))
    wanted, stored = named.select(FINGERPRINT).distinct(), _stored(pairs, path)
    if stored is not None:
        wanted = wanted.join(stored.select(FINGERPRINT), FINGERPRINT, "left_anti")
    missing = marked.join(broadcast_if_small(written(wanted)), FINGERPRINT, "left_semi").dropDuplicates([FINGERPRINT])
    missing = missing.select(FINGERPRINT, "query", "text").repartition(shuffle_partitions(pairs), FINGERPRINT)
    missing.select(FINGERPRINT, scorer(F.col("query"), F.col("text")).alias("score")).write.mode("append").parquet(path)
    scores = pairs.sparkSession.read.parquet(path).dropDuplicates([FINGERPRINT])
    return named.join(scores, FINGERPRINT).select(*rest, "score")
