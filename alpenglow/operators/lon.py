"""Local optima networks: how configurations two edits from a peak fall into other basins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.operators.bitreach import reach_counts, sizes
from alpenglow.operators.graph import pagerank
from alpenglow.plans.cut import written


@dataclass
class OptimaNetwork:
    """``nodes``: peaks with their measures; ``edges``: (src, dst, weight)."""

    nodes: DataFrame
    edges: DataFrame


def two_edits(peaks: DataFrame, variables: list) -> DataFrame:
    """``(peak, cfg)`` of all configurations that change exactly two positions of a peak by one typed step each."""
    n = len(variables)
    kinds = F.array(*[F.lit(v.kind) for v in variables])
    top = F.array(*[F.lit(v.levels - 1) for v in variables])

    def values(i):
        kind, x, most = F.element_at(kinds, i + 1), F.element_at("cfg", i + 1), F.element_at(top, i + 1)
        every = F.filter(F.sequence(F.lit(0), most), lambda k: k != x)
        return F.when(kind == "ordinal", F.filter(F.array(x - 1, x + 1), lambda k: (k >= 0) & (k <= most))).otherwise(every)

    rows = peaks.where(F.lit(n) > 1).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(max(n - 2, 0)))))
    rows = rows.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.lit(n - 1))))
    rows = rows.withColumn("a", F.explode(values(F.col("i")))).withColumn("b", F.explode(values(F.col("j"))))
    return rows.select("peak", F.transform("cfg", lambda x, k: F.when(k == F.col("i"), F.col("a")).when(k == F.col("j"), F.col("b")).otherwise(x)).alias("cfg"))


def local_optima_network(land, mlon: bool = True, min_edge_freq: int = 3, trim: int | None = None) -> OptimaNetwork:
    """The network of peaks; an edge's weight counts the peak's two-edit neighbours in the other basin.

    Counts up to ``min_edge_freq`` are dropped. ``mlon`` keeps edges to optima that are not worse,
    ``trim`` the strongest edges out of each peak (ties to the smaller target). Escape difficulty and
    improvement rate are taken before both.
    """
    if trim is not None and trim < 1:
        raise ParameterError("trim must be 1 or more")
    peaks = land.optima.where("is_lo and node_id = peak").select("peak").join(land.nodes.select(F.col("node_id").alias("peak"), "cfg", "fitness"), "peak")
    where = land.nodes.select("node_id", "cfg").join(land.basins.select("node_id", "basin_index"), "node_id")
    near = two_edits(peaks.select("peak", "cfg"), land.variables).join(where, "cfg")
    counts = written(near.groupBy(F.col("peak").alias("src"), F.col("basin_index").alias("dst")).agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") > min_edge_freq), "escapes")
    own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("weight")).otherwise(0))
    away = F.sum(F.when(F.col("src") != F.col("dst"), F.col("weight")).otherwise(0))
    escape = counts.groupBy("src").agg(F.when(away > 0, own / (own + away)).otherwise(1.0).alias("escape_difficulty")).withColumnRenamed("src", "peak")
    f = peaks.select(F.col("peak").alias("src"), F.col("fitness").alias("f1"))
    g = peaks.select(F.col("peak").alias("dst"), F.col("fitness").alias("f2"))
    edges = written(counts.where("src <> dst").join(f, "src").join(g, "dst"), "lon-edges")
    better = (F.col("f2") > F.col("f1")) if land.maximize else (F.col("f2") < F.col("f1"))
    worse = (F.col("f2") < F.col("f1")) if land.maximize else (F.col("f2") > F.col("f1"))
    improve = edges.groupBy(F.col("src").alias("peak")).agg((F.sum(F.when(better, F.col("weight")).otherwise(0)) / F.sum("weight")).alias("improve_rate"))
    if mlon:
        edges = edges.where(~worse)
    if trim is not None:
        order = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        edges = edges.withColumn("k", F.row_number().over(order)).where(F.col("k") <= trim)
    edges = written(edges.select("src", "dst", "weight"), "lon-edges")
    ways = reach_counts(edges, peaks.select(F.col("peak").alias("key"), F.col("peak").alias("node")), "dst", "src")
    access = sizes(ways).select(F.col("key").alias("peak"), F.col("size").alias("accessibility"))
    outs = edges.groupBy(F.col("src").alias("peak")).agg(F.count(F.lit(1)).alias("out_degree"))
    ins = edges.groupBy(F.col("dst").alias("peak")).agg(F.count(F.lit(1)).alias("in_degree"))
    ranks = pagerank(peaks.select(F.col("peak").alias("node_id")), edges, "weight").withColumnRenamed("node_id", "peak")
    basins = land.basin_sizes.withColumnRenamed("node_id", "peak")
    rows = peaks.select("peak", "fitness").join(basins, "peak", "left")
    for part in (escape, improve, access, outs, ins, ranks):
        rows = rows.join(part, "peak", "left")
    return OptimaNetwork(rows.fillna({"escape_difficulty": 1.0, "improve_rate": 0.0, "out_degree": 0, "in_degree": 0}), edges)
