"""Positions and running totals in a global order, without moving all rows to one task.

Rows are range-partitioned by the order; each partition numbers its own rows, and the partitions'
totals, a row each, give every partition its offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.plans.cut import written


#: Rows up to which a global order is cheaper in one task than in range partitions.
SMALL = 100_000


def running_total(df: DataFrame, order: list[str], value: Column | None = None, name: str = "before", small: bool = False) -> DataFrame:
    """``df`` with the sum of ``value`` (by default 1) over all rows that come earlier in ``order``; ties by nothing else.

    ``small``: the caller knows that there are at most ``SMALL`` rows, which one task then orders.
    """
    if small:
        whole = Window.orderBy(*order)
        if value is None:
            return df.withColumn(name, (F.row_number().over(whole) - 1).cast("long"))
        return df.withColumn(name, F.coalesce(F.sum(value).over(whole.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ordered = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    amount = F.lit(1).cast("long") if value is None else value
    table = written(ordered.withColumn("_amount", amount).withColumn("_row", F.monotonically_increasing_id()), "ordered")
    table = table.withColumn("_part", F.shiftright("_row", 33))
    totals = sorted((r[0], r[1]) for r in table.groupBy("_part").agg(F.sum("_amount")).collect())
    start, offset = 0, []
    for part, total in totals:
        offset.append((part, start))
        start += total
    inner = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    if value is None:
        inside = F.col("_row") - F.shiftleft(F.col("_part"), 33)
    else:
        inside = F.coalesce(F.sum("_amount").over(inner), F.lit(0))
    if not offset:
        return table.select(*df.columns, F.lit(0).cast("long").alias(name))
    shift = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in offset for x in pair]), F.col("_part")) if len(offset) <= 256 else None
    if shift is None:
        offsets = df.sparkSession.createDataFrame(offset, "_part long, _offset long")
        table, shift = table.join(F.broadcast(offsets), "_part"), F.col("_offset")  # a row a partition
    return table.select(*df.columns, (inside + shift).alias(name))


def numbered(df: DataFrame, order: list[str], name: str = "node_id", small: bool = False) -> DataFrame:
    """``df`` with 0-based positions in ``order`` (which should have no ties) as column ``name``."""
    return running_total(df, order, name=name, small=small)


def average_rank(df: DataFrame, column: str, name: str, small: bool = False) -> DataFrame:
    """``df`` with the 1-based rank of ``column``; equal values share the mean of their ranks. Nulls have no rank."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, [column], F.col("_n"), "_before", small).select(F.col(column), (F.col("_before") + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranked, column, "left")
