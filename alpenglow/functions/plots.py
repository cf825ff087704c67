"""The data behind the usual plots, as tables; drawing is left to a plotting library."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.functions import linalg
from alpenglow.operators import walks


def diminishing_return(land) -> DataFrame:
    """``(fitness, gain)`` of every edge from its worse end."""
    f = land.nodes.select(F.col("node_id").alias("src"), "fitness")
    return land.edges.join(f, "src").select("fitness", F.col("delta_fit").alias("gain"))


def fitness_distance(land) -> DataFrame:
    return land.dist_to_go.join(land.nodes.select("node_id", "fitness"), "node_id").select("dist_go", "fitness")


def neighbor_fitness(land) -> DataFrame:
    return land.neighbour_fitness.join(land.nodes.select("node_id", "fitness"), "node_id").where("mean_neighbor_fit is not null").select("fitness", "mean_neighbor_fit")


def regression_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """``(slope, intercept, r2)`` of y on x."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def adaptive_walks(land, n_walks: int | None = None, seed: int = 0) -> DataFrame:
    """``(step, mean_fitness, alive)`` over climbs from every node, or from ``n_walks`` of them drawn by ``seed``."""
    if n_walks is None:
        paths = walks.climb_paths(land.nodes, land.pointers)
    else:
        if n_walks < 1:
            raise ParameterError("n_walks is a positive number")
        starts = land.nodes.select("node_id").orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(n_walks)
        paths = walks.climbs_from(starts, land.nodes, land.pointers)
    return paths.groupBy("step").agg(F.avg("fitness").alias("mean_fitness"), F.count(F.lit(1)).alias("alive")).orderBy("step")


def _phi(land) -> DataFrame:
    """``(phi, fitness)``: the additive fit and the fitness of every configuration."""
    from alpenglow.plans.metrics import _additive

    design, n = _additive(land)
    fit = linalg.least_squares(land.nodes, design, n)

    def predict(batches):
        import pyarrow as pa

        for b in batches:
            codes = np.asarray(b.column(0).flatten()).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([pa.array(fit.intercept + design(codes).astype(float) @ fit.coefficients), b.column(1)], names=["phi", "fitness"])

    return land.nodes.select("cfg", "fitness").mapInArrow(predict, "phi double, fitness double")


def global_epistasis(land, bins: int = 20) -> DataFrame:
    """``(bin, phi, fitness, n)``: fitness against the additive fit, in equal bins of the latter."""
    rows = _phi(land)
    low, high = rows.agg(F.min("phi"), F.max("phi")).first()
    bin_ = F.least(F.width_bucket("phi", F.lit(low), F.lit(high if high > low else low + 1), F.lit(bins)), F.lit(bins))
    return rows.groupBy(bin_.alias("bin")).agg(F.avg("phi").alias("phi"), F.avg("fitness").alias("fitness"), F.count(F.lit(1)).alias("n")).orderBy("bin")


def global_epistasis_curve(land, degree: int = 3, points: int = 100) -> DataFrame:
    """``(phi, curve)``: the polynomial of the additive fit that is nearest to fitness, at even points of the fit's range."""
    rows = _phi(land)
    low, high, mean, sd = rows.agg(F.min("phi"), F.max("phi"), F.avg("phi"), F.stddev_pop("phi")).first()
    sd = sd or 1.0  # powers of standard units, so that their products keep their digits
    powers = lambda z: np.column_stack([z[:, 0] ** k for k in range(1, degree + 1)])
    fit = linalg.least_squares(rows.select(F.array((F.col("phi") - mean) / sd).alias("cfg"), "fitness"), powers, degree)
    x = np.linspace(low, high, points)
    y = fit.intercept + powers(((x - mean) / sd)[:, None]) @ fit.coefficients
    return land.spark.createDataFrame([(float(p), float(c)) for p, c in zip(x, y)], "phi double, curve double")


def fitness_density(land, points: int = 200) -> DataFrame:
    """``(point, fitness, density)``: Gaussian kernel density at even points of the range of fitness, with the bandwidth sd * n^(-1/5).

    Each task adds up its own rows' kernels; a landscape of one fitness value has no density and gives no rows.
    """
    low, high, sd, n = land.nodes.agg(F.min("fitness"), F.max("fitness"), F.stddev_samp("fitness"), F.count(F.lit(1))).first()
    if not sd:
        return land.spark.createDataFrame([], "point int, fitness double, density double")
    at, width = np.linspace(low, high, points), sd * n**-0.2

    def kernels(batches):
        import pyarrow as pa

        total = np.zeros(points)
        for b in batches:
            f = np.asarray(b.column(0)).astype(float)
            for a in range(0, len(f), 4096):
                total += np.exp(-(((f[a : a + 4096, None] - at) / width) ** 2) / 2).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(points), pa.int32()), pa.array(at), pa.array(total)], names=["point", "fitness", "s"])

    each = land.nodes.select("fitness").mapInArrow(kernels, "point int, fitness double, s double")
    return each.groupBy("point", "fitness").agg((F.sum("s") / (n * width * np.sqrt(2 * np.pi))).alias("density")).orderBy("point")


def fitness_histogram(land, bins: int = 50) -> DataFrame:
    """``(bin, n)`` of equal bins of fitness."""
    low, high = land.nodes.agg(F.min("fitness"), F.max("fitness")).first()
    bin_ = F.least(F.width_bucket("fitness", F.lit(low), F.lit(high if high > low else low + 1), F.lit(bins)), F.lit(bins))
    return land.nodes.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin")


def combined_effects(land, changes: dict[str, tuple]) -> DataFrame:
    """``(effect)`` of changing several columns from one value to another at once, over all shared backgrounds."""
    rest = [c for c in land.columns if c not in changes]
    before, after = land.nodes, land.nodes
    for c, (old, new) in changes.items():
        before, after = before.where(F.col(f"`{c}`") == F.lit(old)), after.where(F.col(f"`{c}`") == F.lit(new))
    a = before.select(*rest, F.col("fitness").alias("f0"))
    b = after.select(*rest, F.col("fitness").alias("f1"))
    return (a.join(b, rest) if rest else a.join(b)).select((F.col("f1") - F.col("f0")).alias("effect"))


def basin_fitness(land) -> DataFrame:
    """``(fitness, size_basin_greedy, size_basin_accessible)`` of the peaks."""
    return land.basin_sizes.join(land.accessible_paths, "node_id").join(land.nodes.select("node_id", "fitness"), "node_id").select("fitness", "size_basin_greedy", "size_basin_accessible")
