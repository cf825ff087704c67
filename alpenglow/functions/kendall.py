"""Kendall's tau-b of any number of rows: no task orders or holds more than a bounded block.

Distinct pairs are put in the order of x (then y) and cut into blocks. Inversions inside a block are
counted by merging, in a task each. Those between blocks are counted over a dyadic tree: at every
level, each node's left and right half meet in the order of y, and a running total over range
partitions tells every right row how much of its left half is above it. A pair of blocks meets at
one level only, so the levels' sums add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.functions.numbering import numbered, running_total
from alpenglow.plans.cut import written

#: Rows of a block.
BLOCK = 65_536
EXACT = "decimal(38,0)"


def inversions(y: np.ndarray, weight: np.ndarray) -> int:
    """Weighted pairs i < j with y[i] > y[j], by merging runs bottom-up."""
    y, weight, total, width, n = y.copy(), weight.astype(np.int64 if weight.sum() < 1 << 31 else object), 0, 1, len(y)
    while width < n:
        for a in range(0, n, 2 * width):
            m, b = min(a + width, n), min(a + 2 * width, n)
            left, wl = y[a:m], weight[a:m]
            tail = np.r_[np.cumsum(wl[::-1])[::-1], 0]
            total += int((tail[np.searchsorted(left, y[m:b], "right")] * weight[m:b]).sum())
            order = np.argsort(y[a:b], kind="stable")
            y[a:b], weight[a:b] = y[a:b][order], weight[a:b][order]
        width *= 2
    return total


def _inside(pairs: DataFrame) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(table.column("at")))
        found = inversions(np.asarray(table.column("y"))[order], np.asarray(table.column("n"))[order])
        return pa.table({"n": pa.array([str(found)])})

    return pairs.groupBy("block").applyInArrow(run, "n string").select(F.col("n").cast(EXACT).alias("n"))


def _between(pairs: DataFrame, levels: int) -> DataFrame:
    """``(n)``: inversions between the halves of each node of the tree, in parts."""
    each = pairs.select("y", "n", "at", F.col("block"), F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    half = F.expr("shiftright(block, level)")
    rows = each.select("level", F.shiftright(half, 1).alias("node"), (half.bitwiseAND(F.lit(1)) == 0).alias("left"), (-F.col("y")).alias("down"), "n", "at")
    # above come first; of equal y the right half, as ties are no inversions
    ranked = running_total(rows, ["level", "node", "down", "left", "at"], F.when(F.col("left"), F.col("n")).otherwise(0).cast("long"), "before")
    right = F.when(~F.col("left"), F.col("n")).otherwise(0).cast(EXACT)
    nodes = ranked.groupBy("level", "node").agg(F.min("before").cast(EXACT).alias("base"), F.sum(right * F.col("before").cast(EXACT)).cast(EXACT).alias("s"), F.sum(right).cast(EXACT).alias("r"))
    return nodes.select((F.col("s") - F.col("base") * F.col("r")).cast(EXACT).alias("n"))


def kendall(df: DataFrame, x: str, y: str, name: str = "value", block: int | None = None) -> DataFrame:
    """One row ``(name)``: tau-b; null for fewer than two rows or a constant side. Rows with a null side don't count."""
    block = block or BLOCK
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    counts = written(both.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")), "pairs")
    pairs = written(numbered(counts, ["x", "y"], "at").withColumn("block", F.floor(F.col("at") / block).cast("int")), "ordered")
    tied = lambda *by: counts.groupBy(*by).agg(F.sum("n").cast("decimal(19,0)").alias("c")).agg(F.sum(F.col("c") * (F.col("c") - 1)).cast(EXACT).alias("t"))
    total, blocks = pairs.agg(F.sum("n"), F.max("block")).first()
    if not total:
        return df.sparkSession.createDataFrame([(None,)], f"{name} double")
    worse = _inside(pairs)
    if blocks:
        worse = worse.union(_between(pairs, int(blocks).bit_length()))
    # a row each
    row = tied("x").toDF("tx").join(tied("y").toDF("ty")).join(tied("x", "y").toDF("both")).join(worse.agg(F.coalesce(F.sum("n"), F.lit(0)).cast(EXACT).alias("worse")))
    tx, ty, all_ = (F.col(c).cast("double") / 2 for c in ("tx", "ty", "both"))
    bad = F.col("worse").cast("double")
    whole = F.lit(float(total * (total - 1) // 2))
    return row.select(F.try_divide(whole - tx - ty + all_ - 2 * bad, F.sqrt(whole - tx) * F.sqrt(whole - ty)).alias(name))
