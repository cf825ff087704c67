"""Plateaus, optima and basins as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.functions.numbering import numbered
from alpenglow.operators import local
from alpenglow.operators.components import components
from alpenglow.operators.graph import follow, reach


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node_id, in_degree, out_degree)`` on improving edges; 0 without any."""
    both = edges.select(F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(edges.select("dst", F.lit(0), F.lit(1)))
    counts = both.groupBy("node_id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return nodes.select("node_id").join(counts, "node_id", "left").select("node_id", zero(F.col("i")).alias("in_degree"), zero(F.col("o")).alias("out_degree"))


def plateaus(nodes: DataFrame, neutral: DataFrame, small: bool = False) -> DataFrame:
    """``(node_id, plateau_id, plateau_size, peak)``: components of neutral pairs, numbered by least member; -1 and 1 for other nodes."""
    found = components(neutral, limit=local.LIMIT)
    sizes = found.groupBy("root").agg(F.count(F.lit(1)).alias("plateau_size"))
    named = numbered(sizes, ["root"], "plateau_id", small)
    own = found.join(named, "root").select(F.col("node").alias("node_id"), "plateau_id", "plateau_size", F.col("root").alias("peak"))
    return nodes.select("node_id").join(own, "node_id", "left").select("node_id", F.coalesce("plateau_id", F.lit(-1)).cast("long").alias("plateau_id"), F.coalesce("plateau_size", F.lit(1)).cast("long").alias("plateau_size"), F.coalesce("peak", "node_id").alias("peak"))


def exits(nodes: DataFrame, edges: DataFrame, plateau: DataFrame, epsilon: float, maximize: bool) -> DataFrame:
    """``(plateau_id, member, to)``: improving edges out of a plateau to nodes that beat its best by more than epsilon."""
    on = plateau.where("plateau_id >= 0").select("node_id", "plateau_id").join(nodes.select("node_id", "fitness"), "node_id")
    best = on.groupBy("plateau_id").agg((F.max if maximize else F.min)("fitness").alias("best"))
    members = on.select(F.col("node_id").alias("src"), "plateau_id")
    others = plateau.select(F.col("node_id").alias("dst"), F.col("plateau_id").alias("other"))
    target = nodes.select(F.col("node_id").alias("dst"), F.col("fitness").alias("f"))
    gain = (F.col("f") - F.col("best")) if maximize else (F.col("best") - F.col("f"))
    out = edges.select("src", "dst").join(members, "src").join(others, "dst").where("other <> plateau_id").join(best, "plateau_id").join(target, "dst")
    return out.where(gain > epsilon).select("plateau_id", F.col("src").alias("member"), F.col("dst").alias("to"))


def local_optima(nodes: DataFrame, degree: DataFrame, plateau: DataFrame, left: DataFrame) -> DataFrame:
    """``(node_id, is_lo, peak)``: nodes without a way up; a plateau counts as a whole."""
    free = left.select("plateau_id").distinct().withColumn("leaves", F.lit(True))
    rows = degree.join(plateau, "node_id").join(free, "plateau_id", "left")
    is_lo = F.when(F.col("plateau_id") < 0, F.col("out_degree") == 0).otherwise(F.col("leaves").isNull())
    return rows.select("node_id", is_lo.alias("is_lo"), "peak")


STRATEGIES = ("best-improvement", "first-improvement")


def climb_pointers(
    nodes: DataFrame, edges: DataFrame, plateau: DataFrame | None = None, left: DataFrame | None = None, strategy: str = "best-improvement", exit_by: str = "first-improvement",
    maximize: bool = True, seed: int = 0,
) -> DataFrame:
    """``(node, to, cost)``: each node's successor in a climb; sinks point to themselves.

    By ``best-improvement`` that is the one of greatest fitness (whatever the direction of search),
    ties to the least id; by ``first-improvement`` any, drawn by ``seed``. With plateaus, a sink on one
    that can be left points to its exit: the first one is the least member's least target, the best
    one the target that gains most, the first of equals.
    """
    for given in (strategy, exit_by):
        if given not in STRATEGIES:
            raise ParameterError(f"{given!r} is none of {STRATEGIES}")
    f = nodes.select(F.col("node_id").alias("dst"), F.col("fitness").alias("f"))
    if strategy == "best-improvement":
        ways = edges.select("src", "dst").join(f, "dst")
    else:
        ways = edges.select("src", "dst", F.xxhash64("src", "dst", F.lit(seed)).alias("f"))
    best = ways.groupBy("src").agg(F.max(F.struct(F.col("f"), (-F.col("dst")).alias("neg"))).alias("m"))
    rows = nodes.select(F.col("node_id").alias("node")).join(best.select(F.col("src").alias("node"), (-F.col("m.neg")).alias("to")), "node", "left")
    if plateau is not None and left is not None:
        if exit_by == "best-improvement":
            gain = (-F.col("f") if maximize else F.col("f")).alias("gain")
            left = left.join(f.withColumnRenamed("dst", "to"), "to").select("plateau_id", gain, "member", "to")
        order = F.struct(*[c for c in left.columns if c != "plateau_id"])
        first = left.groupBy("plateau_id").agg(F.min(order).alias("m")).select("plateau_id", F.col("m.to").alias("exit"))
        on = plateau.select(F.col("node_id").alias("node"), "plateau_id").where("plateau_id >= 0").join(first, "plateau_id")
        rows = rows.join(on.select("node", "exit"), "node", "left").withColumn("to", F.coalesce("to", "exit"))
    return rows.select("node", F.coalesce("to", "node").alias("to"), F.lit(1).alias("cost"))


def greedy_basins(nodes: DataFrame, pointers: DataFrame, optima: DataFrame) -> DataFrame:
    """``(node_id, basin_index, steps)``: the optimum that climbing ends in; optima are in their own."""
    ends = follow(pointers)
    peak = optima.select(F.col("node_id").alias("target"), F.col("peak").alias("target_peak"))
    rows = ends.join(peak, "target").withColumnRenamed("node", "node_id").join(optima, "node_id")
    return rows.select("node_id", F.when(F.col("is_lo"), F.col("peak")).otherwise(F.col("target_peak")).alias("basin_index"), F.when(F.col("is_lo"), 0).otherwise(F.col("steps")).cast("long").alias("steps"))


def basin_sizes(basins: DataFrame) -> DataFrame:
    """``(node_id, size_basin_greedy, radius_basin_greedy)`` of each peak."""
    return basins.groupBy(F.col("basin_index").alias("node_id")).agg(F.count(F.lit(1)).alias("size_basin_greedy"), F.max("steps").alias("radius_basin_greedy"))


def accessible(edges: DataFrame, optima: DataFrame) -> DataFrame:
    """``(peak, node, dist)``: nodes from which improving edges lead to a peak, its plateau's members included."""
    seeds = optima.where("is_lo").select(F.col("peak").alias("key"), F.col("node_id").alias("node"))
    return reach(edges, seeds, "dst", "src").withColumnRenamed("key", "peak")


def symmetric(edges: DataFrame, neutral: DataFrame | None = None) -> DataFrame:
    """``(node_id, other)`` both ways, of improving edges and, if given, neutral pairs."""
    pairs = edges.select("src", "dst").toDF("u", "v")
    if neutral is not None:
        pairs = pairs.union(neutral.select("u", "v"))
    return pairs.select(F.col("u").alias("node_id"), F.col("v").alias("other")).union(pairs.select("v", "u"))


def neighbour_fitness(nodes: DataFrame, edges: DataFrame, neutral: DataFrame) -> DataFrame:
    """``(node_id, mean_neighbor_fit)``, null without neighbours."""
    f = nodes.select(F.col("node_id").alias("other"), F.col("fitness").alias("f"))
    means = symmetric(edges, neutral).join(f, "other").groupBy("node_id").agg(F.avg("f").alias("mean_neighbor_fit"))
    return nodes.select("node_id").join(means, "node_id", "left")


def distance(kind: str | list[str] | Callable[[Column, Column], Column], a: Column, b: Column) -> Column:
    """Hamming or Manhattan distance of two code arrays, the sum of both by each position's kind, or one's own function of both."""
    if callable(kind):
        return kind(a, b)
    if kind == "hamming":
        parts = F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1))
    elif kind == "manhattan":
        parts = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    else:
        ordinal = F.array(*[F.lit(k == "ordinal") for k in kind])
        step = F.zip_with(a, b, lambda x, y: F.struct(F.abs(x - y).alias("m"), F.when(x == y, 0).otherwise(1).alias("h")))
        parts = F.zip_with(step, ordinal, lambda s, o: F.when(o, s["m"]).otherwise(s["h"]))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda s, x: s + x)


def mean_distances(nodes: DataFrame, targets: DataFrame, kind: str | list[str], n_positions: int) -> DataFrame:
    """``(lo, mean_distance)`` of all nodes to each target ``(lo, cfg)``, from the counts of every position's codes.

    A distance is a sum over positions, so no node meets a target: running sums in the order of the
    codes give what a code costs at its position.
    """
    kinds = {"hamming": ["hamming"] * n_positions, "manhattan": ["ordinal"] * n_positions}.get(kind, kind) if isinstance(kind, str) else kind
    counts = nodes.select(F.posexplode("cfg").alias("p", "code")).groupBy("p", "code").agg(F.count(F.lit(1)).alias("n"))
    whole, below = Window.partitionBy("p"), Window.partitionBy("p").orderBy("code")
    total, mass = F.sum("n").over(whole), F.sum(F.col("n") * F.col("code")).over(whole)
    n_to, mass_to = F.sum("n").over(below), F.sum(F.col("n") * F.col("code")).over(below)
    steps = F.col("code") * n_to - mass_to + (mass - mass_to) - F.col("code") * (total - n_to)
    ordinal = F.element_at(F.array(*[F.lit(k == "ordinal") for k in kinds]), F.col("p") + 1)
    cost = counts.select("p", "code", (F.when(ordinal, steps).otherwise(total - F.col("n")) / total).alias("cost"))
    return targets.select("lo", F.posexplode("cfg").alias("p", "code")).join(cost, ["p", "code"]).groupBy("lo").agg(F.sum("cost").alias("mean_distance"))
