"""Coefficients of complete grids by a transform, position after position, instead of a solve.

On a complete grid the ensemble matrix is a product of small matrices, one a position, whose inverse
takes the mean over the letters, and each letter's value less the wild type's. A round applies some
positions at once: rows that agree elsewhere are one group of an aggregation with a sum for each
combination of the round's letters, which then becomes its rows again. No matrix is made, and of all
n coefficients each round moves one row.
"""

from __future__ import annotations

from itertools import product
from math import prod

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.plans.cut import drop_tables, written

#: Sums of an aggregation at most: combinations of letters of the positions of a round.
SUMS = 32


def rounds(sizes: list[int], most: int = SUMS) -> list[list[int]]:
    """Positions, in order, in groups of at most ``most`` combinations (a larger position is alone)."""
    out: list[list[int]] = []
    for i, n in enumerate(sizes):
        if out and prod(sizes[j] for j in out[-1]) * n <= most:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def ensemble(cells: DataFrame, letters: list[list[int]], wild: list[int], value: str = "fitness") -> DataFrame:
    """``(term array<int>, coefficient)`` of a complete grid ``(cfg, value)``; a term has a letter's code, or -1 where it fixes none.

    ``letters`` are the codes of each position, the wild type's among them.
    """
    sizes = [len(x) for x in letters]
    now = cells.select(F.col("cfg").alias("term"), F.col(value).cast("double").alias("coefficient"))
    for k, group in enumerate(rounds(sizes)):
        small = prod(sizes[i] for i in group) <= SUMS
        after = written(_at_once(now, letters, wild, group) if small else _one(now, wild, group[0]), "transform")
        if k:
            drop_tables(now)
        now = after
    return now


def _one(rows: DataFrame, wild: list[int], at: int) -> DataFrame:
    """A position of any number of letters: the wild type's row becomes the mean of its line, the others lose the wild type's value."""
    own = F.element_at("term", at + 1)
    line = Window.partitionBy(F.transform("term", lambda x, i: F.when(i == at, -2).otherwise(x)))
    rows = rows.withColumns({"mean": F.avg("coefficient").over(line), "base": F.max(F.when(own == wild[at], F.col("coefficient"))).over(line), "is_wild": own == wild[at]})
    term = F.transform("term", lambda x, i: F.when((i == at) & F.col("is_wild"), -1).otherwise(x))
    return rows.select(term.alias("term"), F.when(F.col("is_wild"), F.col("mean")).otherwise(F.col("coefficient") - F.col("base")).alias("coefficient"))


def _at_once(rows: DataFrame, letters: list[list[int]], wild: list[int], group: list[int]) -> DataFrame:
    """Several positions of few letters: a sum for each combination of what they become."""
    here = list(product(*[letters[i] for i in group]))
    outs = list(product(*[[-1, *[k for k in letters[i] if k != wild[i]]] for i in group]))
    place, step = F.lit(0), 1  # of a row's own letters in `here`
    for i in reversed(group):
        place = place + (F.array_position(F.array(*[F.lit(k) for k in letters[i]]), F.element_at("term", i + 1)) - 1) * step
        step *= len(letters[i])
    held = rows.select(F.transform("term", lambda x, i: F.when(i.isin(group), -2).otherwise(x)).alias("rest"), place.cast("int").alias("place"), "coefficient")

    def weight(out: tuple[int, ...], cell: tuple[int, ...]) -> float:
        return prod(1 / len(letters[i]) if k == -1 else float(x == k) - float(x == wild[i]) for i, k, x in zip(group, out, cell))

    sums = []
    for out in outs:
        w = F.element_at(F.array(*[F.lit(weight(out, cell)) for cell in here]), F.col("place") + 1)
        sums.append(F.struct(F.array(*[F.lit(k) for k in out]).alias("own"), F.sum(w * F.col("coefficient")).alias("coefficient")))
    each = held.groupBy("rest").agg(F.array(*sums).alias("all")).select("rest", F.explode("all").alias("o"))
    index = F.array(*[F.lit(group.index(i) if i in group else -1) for i in range(len(letters))])
    term = F.transform("rest", lambda x, i: F.when(F.get(index, i) >= 0, F.get(F.col("o.own"), F.get(index, i))).otherwise(x))
    return each.select(term.alias("term"), F.col("o.coefficient").alias("coefficient"))
