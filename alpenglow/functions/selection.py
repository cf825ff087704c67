"""Exact quantiles of many groups at once, without a buffer for any: selection by narrowing histograms.

Every wanted rank starts with its group's whole range. A round counts the rows of each range in a
number of steps, one aggregation for all ranks of all groups, and leaves the step that holds the rank,
with the least and greatest value seen in it, as the next range. A range of one value is done; one of
few rows is ordered. So rows are read a few times and combined before they move, and no group's rows
come together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.plans.cut import written

#: Steps of a range in a round; rows of a range that are ordered at last; ranges sent to all tasks.
STEPS, FEW, SENT = 256, 512, 100_000


def select(df: DataFrame, by: list[str], value: Column, share: float) -> DataFrame:
    """``(*by, quantile)`` of the non-null values of each group, interpolated between the two nearest ranks.

    Values that are not finite count as null. Groups of nulls only have no row; null keys are a group.
    """
    names = [f"g{i}" for i in range(len(by))]
    rows = written(df.select(*[F.col(c).alias(n) for c, n in zip(by, names)], value.cast("double").alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')"), "values")
    size = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = (F.col("n") - 1) * F.lit(share)
    ranks = F.array_distinct(F.array(F.floor(place).cast("long"), F.ceil(place).cast("long")))
    # what is left to find: rank k of a group, which is rank `want` of the values from low to high
    left = size.select(*names, F.explode(ranks).alias("k"), "low", "high", F.col("n").alias("m")).withColumn("want", F.col("k"))
    left = written(left, "ranges")
    # two ranges a group: few are sent to all tasks; more are joined, which Spark splits where a group is large
    near = F.broadcast if left.limit(SENT + 1).count() <= SENT else lambda x: x
    done, same = [], lambda a, b: [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names]
    while True:
        one = F.col("low") == F.col("high")
        done.append(left.where(one).select(*names, "k", F.col("low").alias("v")))
        open_ = left.where(~one)
        inside = rows.alias("r").join(near(open_).alias("o"), [*same("r", "o"), F.col("r.v").between(F.col("o.low"), F.col("o.high"))])
        held = inside.select(*[F.col(f"o.{n}").alias(n) for n in names], "k", "want", "m", "low", "high", F.col("r.v").alias("v"))
        order = Window.partitionBy(*names, "k").orderBy("v")
        done.append(held.where(F.col("m") <= FEW).withColumn("at", F.row_number().over(order) - 1).where("at = want").select(*names, "k", "v"))
        many = held.where(F.col("m") > FEW)
        if not left.where(~one & (F.col("m") > FEW)).limit(1).count():
            break
        # halves before they are subtracted, so that no width overflows; the greatest value is in the last step
        share_of = F.try_divide(F.col("v") / 2 - F.col("low") / 2, F.col("high") / 2 - F.col("low") / 2)
        share_of = F.coalesce(share_of, F.when(F.col("v") > F.col("low"), 1.0).otherwise(0.0))  # of the least of all numbers
        step = F.least(F.floor(share_of * STEPS), F.lit(STEPS - 1)).cast("int")
        bins = many.withColumn("step", step).groupBy(*names, "k", "want", "step").agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
        before = F.sum("m").over(Window.partitionBy(*names, "k").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
        bins = bins.withColumn("before", F.coalesce(before, F.lit(0)))
        hit = bins.where("want >= before and want < before + m")
        left = written(hit.select(*names, "k", "low", "high", "m", (F.col("want") - F.col("before")).alias("want")), "ranges")
    found = done[0]
    for part in done[1:]:
        found = found.union(part)
    both = size.join(found.withColumnsRenamed({n: f"f{n}" for n in names}), [F.col(n).eqNullSafe(F.col(f"f{n}")) for n in names]) if names else size.join(found)
    low, high = F.max(F.when(F.col("k") == F.floor(place), F.col("v"))), F.max(F.when(F.col("k") == F.ceil(place), F.col("v")))
    part = F.any_value(place - F.floor(place))
    return both.groupBy(*names).agg((low + (high - low) * part).alias("quantile")).select(*[F.col(n).alias(c) for c, n in zip(by, names)], "quantile")


def median(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    return select(df, by, value, 0.5)
