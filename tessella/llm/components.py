"""Connected components of an edge table by minimum labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Each round gives a vertex the smallest label among itself and its neighbours and then its label's own
    label, so that chains shorten by half. Rounds end when no label changes. Hub vertices meet in plain joins,
    which Spark splits, and in minima, which are combined before the shuffle.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "id").select("id", F.col("component").alias("was"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        step = cut(low.join(up, "low").select("id", "was", F.least("low", "up").alias("component")))
        labels = step.select("id", "component")
        if step.filter("was <> component").isEmpty():
            return labels
