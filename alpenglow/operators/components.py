"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations with map-side combining and two joins; no task ever holds a
component, and the number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.operators import local
from alpenglow.plans.cut import drop_tables, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (u > v): link neighbours to the least of each neighbourhood."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = both.join(least, "u")
    if large:  # only neighbours above u move; each still keeps a link to the least
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v", limit: int = 0) -> DataFrame:
    """``(node, root)`` of every node that has a link to another; root is the component's least node.

    Self-links, repeated links and links with a null end don't matter; no links give no rows. Up
    to ``limit`` links are worked on outside Spark; by default none.
    """
    a, b = F.col(u), F.col(v)
    if links := local.fetch(edges.where(a != b).select(a, b), limit):
        node, root = local.components(*links)
        return local.frame(edges, node=node, root=root)
    now = written(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    state = None
    while True:
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(new) == state or not new[0]:
            break
        state, old = tuple(new), now
        now = written(_star(_star(old, True), False), "links")
        drop_tables(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
