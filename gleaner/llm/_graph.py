"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm._shared import cleared, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): every node of the edges with the smallest node that it reaches. Each step is two shuffles by
    node with map-side minima; the steps end when every
    edge points at a node that points nowhere: the smallest of its component.

    The minima are written before they are joined: both sides of the join are then plain shuffles, and adaptive execution
    splits the edges of a hot node over tasks."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = edges.select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u")
        small = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        before, now = now, written(small, "edges")
        cleared(before, low, large, least)
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select("v", F.lit(0), F.lit(1)).toDF("node", "up", "down"))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 OR up > 0 AND down > 0").limit(1).count() == 0:
            break
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
