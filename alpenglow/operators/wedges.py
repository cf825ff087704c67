"""Squares drawn at random, all alike, from an exact count of wedges, without making all squares.

A wedge is a configuration with two neighbours of higher codes at two positions; it is the lower corner
of one square at most, which closes if the fourth configuration exists. Wedges are counted by head:
a pair of neighbours, and how many of its lower end's neighbours differ at a later position.
Running totals of these counts give every wedge a number; drawn numbers find their head by an
equi-join on steps of the totals, and their second neighbour by its place among those of the node.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.functions.numbering import running_total
from alpenglow.plans.cut import written


@dataclass
class Wedges:
    """``heads``: (u, v, p, a, b, fu, fv, place, later, before); ``total`` is how many wedges there are."""

    heads: DataFrame
    total: int


def wedges(pairs: DataFrame) -> Wedges:
    """Of neighbour pairs ``(p, u, v, a, b, fu, fv)`` with a < b."""
    own = Window.partitionBy("u")
    rows = pairs.withColumn("place", F.row_number().over(own.orderBy("p", "b")) - 1)
    last = F.max("place").over(Window.partitionBy("u", "p"))
    rows = rows.withColumn("later", (F.count(F.lit(1)).over(own) - 1 - last).cast("long"))
    heads = written(running_total(rows, ["u", "place"], F.col("later"), "before"), "wedges")
    return Wedges(heads, int(heads.agg(F.coalesce(F.sum("later"), F.lit(0))).first()[0]))


def drawn_squares(nodes: DataFrame, found: Wedges, samples: int, seed: int = 0) -> DataFrame:
    """Squares of ``samples`` wedges drawn with replacement by ``seed``; columns as of :func:`alpenglow.operators.squares.squares`."""
    spark, total = nodes.sparkSession, found.total
    step = max(1, total // samples)
    numbers = spark.range(samples).select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(total, 1))).alias("t")).where(F.lit(total) > 0)
    numbers = numbers.withColumn("step", F.floor(F.col("t") / step))
    end = F.col("before") + F.col("later") - 1
    heads = found.heads.where("later > 0").withColumn("step", F.explode(F.sequence(F.floor(F.col("before") / step), F.floor(end / step))))
    met = numbers.join(heads, "step").where((F.col("t") >= F.col("before")) & (F.col("t") < F.col("before") + F.col("later")))
    # the later neighbours of a node are its last ones
    degree = found.heads.groupBy("u").agg(F.count(F.lit(1)).alias("degree"))
    met = met.join(degree, "u").withColumn("second", (F.col("degree") - F.col("later") + F.col("t") - F.col("before")).cast("int"))
    tails = found.heads.select("u", F.col("place").alias("second"), F.col("p").alias("q"), F.col("a").alias("c"), F.col("b").alias("d"), F.col("v").alias("n01"), F.col("fv").alias("f01"))
    met = met.join(tails, ["u", "second"]).join(nodes.select(F.col("node_id").alias("v"), F.col("cfg").alias("beside")), "v")
    corner = F.transform("beside", lambda x, i: F.when(i == F.col("q"), F.col("d")).otherwise(x))
    fourth = nodes.select(F.col("cfg").alias("corner"), F.col("node_id").alias("n11"), F.col("fitness").alias("f11"))
    whole = met.withColumn("corner", corner).join(fourth, "corner")
    return whole.select("p", "q", "a", "b", "c", "d", F.col("u").alias("n00"), F.col("v").alias("n10"), "n01", "n11", F.col("fu").alias("f00"), F.col("fv").alias("f10"), "f01", "f11")
