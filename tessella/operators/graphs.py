"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.sources.library import keep


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) of the ids in edges (a, b): the least id that each reaches.

    A round hands every id the least label in its neighbourhood and follows labels one step; chains halve, and
    rounds end when nothing changes.
    """
    links = keep(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct())
    held = keep(links.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("component")))
    changed, kept = True, held
    while changed:
        around = links.join(held.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("around"))
        lowered = held.join(around, "id").select("id", F.col("component").alias("before"), F.least("component", "around").alias("label"))
        onward = held.select(F.col("id").alias("label"), F.col("component").alias("onward"))
        after = keep(lowered.join(onward, "label").select("id", "before", F.least("label", "onward").alias("component")), kept)
        kept = after
        changed = not after.filter("before <> component").isEmpty()
        held = after.select("id", "component")
    return held
