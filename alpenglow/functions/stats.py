"""Statistics that Spark lacks or defines otherwise: rank correlations, moments, exact tails."""

from __future__ import annotations

import math
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alpenglow.errors import ParameterError
from alpenglow.functions.kendall import kendall
from alpenglow.functions.numbering import SMALL, average_rank, running_total


def guarded_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null for fewer than two rows or a constant side."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, x: str, y: str, name: str = "value") -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(guarded_corr(F.col(x).cast("double"), F.col(y).cast("double")).alias(name))


def spearman(df: DataFrame, x: str, y: str, name: str = "value") -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    small = both.limit(SMALL + 1).count() <= SMALL
    ranked = average_rank(average_rank(both, "x", "rx", small), "y", "ry", small)
    return ranked.agg(guarded_corr(F.col("rx"), F.col("ry")).alias(name))


CORRELATIONS = {"pearson": pearson, "spearman": spearman, "kendall": kendall}


def correlation(df: DataFrame, x: str, y: str, method: str, name: str = "value") -> DataFrame:
    if method not in CORRELATIONS:
        raise ParameterError(f"method must be one of {sorted(CORRELATIONS)}")
    return CORRELATIONS[method](df, x, y, name)


def binomial_tail(k: int, n: int) -> float:
    """P(X >= k) for n fair coins, exactly for small n and by log-gamma sums beyond."""
    if k <= 0:
        return 1.0
    if k > n:
        return 0.0
    if n <= 1000:
        return sum(math.comb(n, i) for i in range(k, n + 1)) / 2**n
    log = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k, n + 1)]
    top = max(log)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in log))


@F.pandas_udf(T.DoubleType())
def binomial_tail_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_tail(int(a), int(b)) for a, b in zip(k, n)])


def quantiles(df: DataFrame, x: str, shares: tuple[float, ...]) -> list[float]:
    """Exact linear quantiles from the distributed ranks of the distinct values; no task or buffer holds the column."""
    counts = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_total(counts, ["v"], F.col("n"), "before")
    total = counts.agg(F.sum("n")).first()[0]
    places = {k for p in shares for k in (math.floor((total - 1) * p), math.ceil((total - 1) * p))}
    at = " or ".join(f"({k} >= before and {k} < before + n)" for k in sorted(places))
    rows = ranked.where(at).select("v", "before", "n").collect()
    value = lambda k: next(r["v"] for r in rows if r["before"] <= k < r["before"] + r["n"])
    out = []
    for p in shares:
        h = (total - 1) * p
        low, high = value(math.floor(h)), value(math.ceil(h))
        out.append(low + (high - low) * (h - math.floor(h)))
    return out


def moments(df: DataFrame, x: str = "fitness", small: bool = True) -> DataFrame:
    """Population skewness, population kurtosis (3 for a normal distribution), and spread ratios of one column.

    One aggregate if the caller knows the column to be small; else the quantiles come from :func:`quantiles`.
    """
    shares = (0.25, 0.5, 0.75)
    q = F.percentile(x, F.array(*[F.lit(p) for p in shares])) if small else F.array(*[F.lit(v) for v in quantiles(df, x, shares)])
    row = df.agg(F.skewness(x).alias("skewness"), (F.kurtosis(x) + 3).alias("kurtosis"), F.stddev_samp(x).alias("sd"), F.avg(x).alias("mean"), q.alias("q"), F.min(x).alias("low"), F.max(x).alias("high"))
    m, q1, q3 = F.get("q", F.lit(1)), F.get("q", F.lit(0)), F.get("q", F.lit(2))
    ratio = lambda a, b: F.when(b != 0, a / b)
    return row.select(
        "skewness", "kurtosis", ratio(F.col("sd"), F.abs("mean")).alias("cv"), ratio(q3 - q1, F.abs(m)).alias("quartile_coefficient"),
        ratio(m, F.col("mean")).alias("median_mean_ratio"), ratio(F.col("high") - F.col("low"), F.abs(m)).alias("relative_range"),
    )


def cauchy_location(df: DataFrame, x: str = "fitness", rounds: int = 200) -> float:
    """Maximum-likelihood location of a Cauchy distribution, its scale fitted with it.

    The likelihood has one maximum, so where the rounds begin (sketched quartiles) doesn't matter. A round
    is one aggregate of a few sums: it takes Newton's step where the likelihood is curved downwards and
    the step is short, else that of repeated weighted means, which always gains.
    """
    values = df.select(F.col(x).cast("double").alias("x"))
    q1, loc, q3 = values.agg(F.percentile_approx("x", [0.25, 0.5, 0.75], 1000)).first()[0]
    scale = max((q3 - q1) / 2, 1e-12)
    for _ in range(rounds):
        u = (F.col("x") - loc) / scale
        w = 1 / (1 + u * u)
        n, total, mean, a, b, c = values.agg(F.count("x"), F.sum(w), F.sum(w * F.col("x")), F.sum(w * w), F.sum(u * w * w), F.sum(u * w)).first()
        # per square of the scale: slopes and curvatures; u*u*w = 1 - w and u*u*w*w = w - w*w
        g1, g2 = 2 * c * scale, (n - 2 * total) * scale
        h11, h12, h22 = 2 * (total - 2 * a), -4 * b, n - 2 * (n - total) - 4 * (total - a)
        det = h11 * h22 - h12 * h12
        new, new_scale = mean / total, max(scale * math.sqrt(2 * (n - total) / n), 1e-12)
        if h11 < 0 and det > 0:
            step, step_scale = (g2 * h12 - g1 * h22) / det, (g1 * h12 - g2 * h11) / det
            if abs(step) < scale and abs(step_scale) < scale / 2:
                new, new_scale = loc + step, scale + step_scale
        done = abs(new - loc) + abs(new_scale - scale) < 1e-12 * (abs(loc) + scale)
        loc, scale = new, new_scale
        if done:
            break
    return float(loc)
