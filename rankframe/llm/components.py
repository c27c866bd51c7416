"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankframe.functions.ranking import written
from rankframe.llm.skew import skew_join


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of the undirected ``links`` (a, b): label is the smallest node it reaches.

    Every round each node takes the smallest label among its neighbours and then that label's own label, so paths
    halve from round to round. A round is stored; it ends when no label changes. Neighbours' minima combine before
    the shuffle, so a hub of any degree is no hot key.
    """
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("label")))
    while True:
        seen = skew_join(edges.withColumnRenamed("b", "node"), labels, ["node"])
        lowest = seen.groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(lowest, "node").select("node", "label", F.least("label", "near").alias("near"))
        of_label = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        jumped = skew_join(own, of_label, ["near"], "left")
        new = written(jumped.select("node", F.coalesce(F.least("near", "far"), "near").alias("next"), "label"))
        changed = new.filter("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
