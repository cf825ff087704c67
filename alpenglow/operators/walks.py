"""Walks: seeded random walks, and the full paths of climbs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.operators import local
from alpenglow.operators.structure import symmetric
from alpenglow.plans.cut import written


def random_walks(land, n_walks: int, length: int, seed: int = 0, neutral: bool = False, starts: DataFrame | None = None) -> DataFrame:
    """``(walk, step, node_id)``: walks of up to ``length`` nodes over neighbours in either direction.

    Every step takes all walks at once: a hash of seed, walk and step picks the place of the next
    node among its neighbours, so walks are the same however they are dealt. A walk ends at a node
    without neighbours.
    """
    n = land.n_configs
    first = starts if starts is not None else land.spark.range(n_walks).select(F.col("id").alias("walk"), F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(n)).alias("node_id"))
    links = symmetric(land.edges, land.neutral if neutral else None)
    lists = written(links.groupBy("node_id").agg(F.array_sort(F.collect_list("other")).alias("to")), "adjacent")
    now = written(first.select("walk", F.lit(0).alias("step"), "node_id"), "walk")
    found = now
    for step in range(1, length):
        pick = F.pmod(F.xxhash64(F.lit(seed), F.col("walk"), F.lit(step)), F.size("to")).cast("int") + 1
        now = now.join(lists, "node_id").select("walk", F.lit(step).alias("step"), F.element_at("to", pick).alias("node_id"))
        if step % 10 == 0:
            now = written(now, "walk")
        found = found.union(now)
    return written(found, "walks")


def _paths(node: np.ndarray, to: np.ndarray, end: int | None) -> dict[str, np.ndarray]:
    ids, target, _ = local.follow(node, to, np.ones(len(node)))
    order = np.argsort(node)
    next_ = np.searchsorted(ids, to[order])
    at = np.arange(len(ids)) if end is None else np.flatnonzero(target == end)
    start, step, out = ids[at], 0, []
    while len(at):
        out.append((start, np.full(len(at), step), ids[at]))
        go = next_[at] != at
        start, at, step = start[go], next_[at[go]], step + 1
    none = np.zeros(0, np.int64)
    a, b, c = (np.concatenate(x) for x in zip(*out)) if out else (none, none, none)
    return {"start": a, "step": b.astype(np.int32), "node_id": c}


def climbs_from(starts: DataFrame, nodes: DataFrame, pointers: DataFrame) -> DataFrame:
    """``(start, step, node_id, fitness)`` of the climbs from some nodes ``(node_id)``: a round a step for those not at their end."""
    step_to = pointers.where("node <> to").select(F.col("node").alias("node_id"), "to")
    now = written(starts.select(F.col("node_id").alias("start"), F.lit(0).alias("step"), "node_id"), "climbs")
    out = now
    while now.limit(1).count():
        now = written(now.join(step_to, "node_id").select("start", (F.col("step") + 1).alias("step"), F.col("to").alias("node_id")), "climbs")
        out = out.union(now)
    return out.join(nodes.select("node_id", "fitness"), "node_id").select("start", "step", "node_id", "fitness")


def climb_paths(nodes: DataFrame, pointers: DataFrame, end: int | None = None, limit: int | None = None) -> DataFrame:
    """``(start, step, node_id, fitness)`` of every node's climb; with ``end``, of the climbs that end there.

    Grown back from the ends, a round a step, so only paths that count are made.
    """
    if chain := local.fetch(pointers.select("node", "to"), limit):
        return local.frame(nodes, **_paths(*chain, end)).join(nodes.select("node_id", "fitness"), "node_id")
    to = pointers.where("node <> to").select(F.col("to").alias("head"), F.col("node").alias("before"))
    sinks = pointers.where("node = to").select(F.col("node"))
    if end is not None:
        sinks = sinks.where(F.col("node") == end)
    # depth of every node below its end
    level = written(sinks.select("node", F.lit(0).alias("depth")), "level")
    found, depth = level, 0
    while True:
        depth += 1
        level = written(level.join(to, level["node"] == to["head"]).select(F.col("before").alias("node"), F.lit(depth).alias("depth")), "level")
        if not level.limit(1).count():
            break
        found = found.union(level)
    now = found.select(F.col("node").alias("start"), F.lit(0).alias("step"), F.col("node").alias("node_id"))
    out = now
    step_to = pointers.where("node <> to").select(F.col("node").alias("node_id"), "to")
    for step in range(1, depth):
        now = written(now.join(step_to, "node_id").select("start", F.lit(step).alias("step"), F.col("to").alias("node_id")), "paths")
        out = out.union(now)
    return out.join(nodes.select("node_id", "fitness"), "node_id")


def series_autocorrelation(values: DataFrame, lag: int = 1) -> DataFrame:
    """``(walk, value)``: each series's own autocorrelation about its own mean, of ``(walk, step, fitness)``."""
    from pyspark.sql import Window

    w = Window.partitionBy("walk")
    x = values.withColumn("x", F.col("fitness") - F.avg("fitness").over(w)).withColumn("y", F.lag("x", lag).over(w.orderBy("step")))
    return x.groupBy("walk").agg(F.when(F.sum(F.col("x") * F.col("x")) > 0, F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("value"))
