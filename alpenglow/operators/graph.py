"""Iterative graph operators on node and edge tables: reachability, pointer doubling, PageRank.

Every round ends in a table of its own (see :mod:`alpenglow.plans.cut`), so plans stay short and a
lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.operators import local
from alpenglow.plans.cut import written


def reach(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", limit: int | None = None) -> DataFrame:
    """``(key, node, dist)``: all nodes reached from each key's seeds ``(key, node)`` along ``src -> dst``, with their least number of steps.

    One round a level, for all keys at once: the frontier joins the edges and drops what its key
    has seen. A pair of key and node enters the frontier once.
    """
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    if (links := local.fetch(step, limit)) and (starts := local.fetch(seeds.select("key", "node").distinct(), limit)) and (got := local.reach(*links, *starts)):
        return local.frame(seeds, key=got[0], node=got[1], dist=got[2])
    frontier = written(seeds.select("key", "node").distinct().withColumn("dist", F.lit(0)), "reach")
    found, level = frontier, 0
    while True:
        level += 1
        new = frontier.join(step, "node").select("key", F.col("next").alias("node")).distinct().join(found.select("key", "node"), ["key", "node"], "left_anti")
        frontier = written(new.withColumn("dist", F.lit(level)), "reach")
        if not frontier.limit(1).count():
            return found
        found = found.union(frontier)


def follow(pointers: DataFrame, limit: int | None = None) -> DataFrame:
    """``(node, target, steps)``: where each node's chain ``(node, to, cost)`` ends; a node that points to itself is an end.

    Pointers are doubled, so chains of length n take log2(n) rounds.
    """
    if chain := local.fetch(pointers.select("node", "to", "cost"), limit):
        got = local.follow(*chain)
        return local.frame(pointers, node=got[0], target=got[1], steps=got[2])
    now = written(pointers.select("node", F.col("to").alias("target"), F.when(F.col("node") == F.col("to"), 0).otherwise(F.col("cost")).cast("long").alias("steps")), "follow")
    while True:
        beyond = now.select(F.col("node").alias("target"), F.col("target").alias("t2"), F.col("steps").alias("s2"))
        new = written(now.join(beyond, "target").select("node", F.col("t2").alias("target"), (F.col("steps") + F.col("s2")).alias("steps"), (F.col("t2") != F.col("target")).alias("moved")), "follow")
        if not new.where("moved").limit(1).count():
            return new.drop("moved")
        now = new.drop("moved")


def pagerank(nodes: DataFrame, edges: DataFrame, weight: str | None = "delta_fit", damping: float = 0.85, tolerance: float = 1e-12, rounds: int = 200, limit: int | None = None) -> DataFrame:
    """``(node_id, pagerank)``, summing to 1; nodes without out-edges spread their rank evenly.

    What such nodes spread is the same for all, so it only scales the ranks: they are pushed without it
    and divided by their sum at the end. A round pushes the residuals above a bound along the edges;
    where edges have no cycle (improving ones) none is left after the longest path, and ranks are exact.
    Else what is left unpushed changes the ranks by at most ``tolerance`` in sum, unless ``rounds`` end first.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    if (ids := local.fetch(nodes.select("node_id").orderBy("node_id"), limit)) and (links := local.fetch(edges.select("src", "dst", w.cast("double").alias("w")), limit)):
        return local.frame(nodes, node_id=ids[0], pagerank=local.pagerank(ids[0], *links, damping, tolerance, rounds))
    total = edges.groupBy("src").agg(F.sum(w).alias("_total"))
    share = written(edges.join(total, "src").select("src", "dst", (w * damping / F.col("_total")).alias("share")), "share")
    bound = tolerance * (1 - damping)
    left = written(nodes.select("node_id", F.lit(1.0).alias("r")), "residuals")
    got: list[DataFrame] = []
    for _ in range(rounds):
        pushed = left.where(F.col("r") > bound)
        if not pushed.limit(1).count():
            break
        got.append(pushed)
        sent = pushed.withColumnRenamed("node_id", "src").join(share, "src").select(F.col("dst").alias("node_id"), (F.col("r") * F.col("share")).alias("r"))
        left = written(left.where(F.col("r") <= bound).union(sent).groupBy("node_id").agg(F.sum("r").alias("r")), "residuals")
        if len(got) == 16:
            got = [written(_summed(got), "ranks")]
    ranks = written(_summed([*got, left]), "ranks")
    whole = ranks.agg(F.sum("r")).first()[0]
    return ranks.select("node_id", (F.col("r") / F.lit(whole or 1.0)).alias("pagerank"))


def _summed(parts: list[DataFrame]) -> DataFrame:
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows.groupBy("node_id").agg(F.sum("r").alias("r"))
