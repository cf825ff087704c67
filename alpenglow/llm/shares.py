"""Links within large groups of sets, each group dealt over many tasks and no pair of it left out.

A group (the texts that share a token) of more than SHARE texts is never in one task. Its shares are
linked first, then one text of each component found so far, dealt anew, for as long as that at
least halves them: copies, however many, become one component by work in proportion to them. What
remains then are texts unlike the rest. Every one that is not of its group's largest component meets
all texts of the group of sizes near its own, in cells of two shares: as many cells as there are
pairs of shares, each of bounded work.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared
from alpenglow.operators.components import components

#: Texts of a share, about.
SHARE = 2048
#: Sizes of similar sets are of one class or of two beside each other: classes grow by more than a fourth.
CLASS = 1.3
LINKS = "u long, v long"


def share(node: Column, n: Column, seed: int) -> Column:
    """The share of a node among those of a group of ``n``."""
    return F.pmod(F.xxhash64(node, F.lit(seed)), F.ceil(n / F.lit(SHARE)))


def split(rows: DataFrame) -> DataFrame:
    """``rows`` (token, ...) with large groups cut into shares that have tokens of their own."""
    many = rows.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARE)
    own = F.xxhash64("token", share(F.col("node"), F.col("n"), 1))
    return rows.join(many, "token", "left").withColumn("token", F.when(F.col("n").isNull(), F.col("token")).otherwise(own)).drop("n")


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    now = components(found).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return shared.written(rows.join(now, "root", "left").select("token", "node", "size", F.coalesce("last", "root").alias("root")), "rooted")


def links(hot: DataFrame, found: DataFrame, compare: Callable[..., pa.Table]) -> DataFrame:
    """``found`` (u, v) and what links the texts of large groups ``hot`` (token, node, size, root) beyond that.

    ``compare(token, node, size, root, asked)`` gives verified links of roots; only pairs with an
    ``asked`` row count, if it isn't None.
    """

    def columns(part: pa.Table) -> list[np.ndarray]:
        return [part.column(c).to_numpy() for c in ("node", "size", "root")]

    def group(part: pa.Table) -> pa.Table:
        return compare(np.zeros(part.num_rows, np.uint64), *columns(part), None)

    def cell(part: pa.Table) -> pa.Table:
        return compare(np.zeros(part.num_rows, np.uint64), *columns(part), part.column("asked").to_numpy())

    before, seed = None, 2
    while True:
        rows = _rooted(hot, found)
        one = rows.groupBy("token", "root").agg(F.min(F.struct("node", "size")).alias("x"), F.count(F.lit(1)).alias("texts"))
        one = shared.written(one.select("token", "root", "x.*", "texts"), "representatives")
        still = one.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("texts", "root")).alias("largest")).where("n > 1")
        m = still.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if not m:
            return found
        if before is not None and 2 * m > before:
            break
        before, seed = m, seed + 1
        dealt = one.join(still, "token").withColumn("share", share(F.col("node"), F.col("n"), seed))
        found = shared.written(found.union(dealt.groupBy("token", "share").applyInArrow(group, LINKS)), "found")
    kind = F.floor(F.log(F.col("size")) / F.lit(math.log(CLASS)))
    rows = rows.join(still.select("token", F.col("largest.root").alias("largest")), "token").withColumn("kind", kind)
    asked = rows.where(F.col("root") != F.col("largest"))
    units = asked.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("asking"))
    met = rows.withColumn("kind", F.explode(F.array(F.col("kind") - 1, F.col("kind"), F.col("kind") + 1)))
    n = met.groupBy("token", "kind").agg(F.count(F.lit(1)).alias("n"))
    units = shared.written(units.join(n, ["token", "kind"]), "units")

    def cells(side: DataFrame, is_asked: bool) -> DataFrame:
        mine, other = ("asking", "n") if is_asked else ("n", "asking")
        at = side.join(units, ["token", "kind"]).withColumn("mine", share(F.col("node"), F.col(mine), 0))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(other) / F.lit(SHARE)) - 1)))
        i, j = ("mine", "other") if is_asked else ("other", "mine")
        return at.select("token", "kind", F.col(i).alias("i"), F.col(j).alias("j"), "node", "size", "root", F.lit(is_asked).alias("asked"))

    return found.union(cells(asked, True).union(cells(met, False)).groupBy("token", "kind", "i", "j").applyInArrow(cell, LINKS))
