"""Landscape metrics: each is a one-row (or tidy) DataFrame, and :func:`value` reads a scalar."""

from __future__ import annotations

import math
from itertools import combinations, product

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.functions import linalg, selection, stats, transform
from alpenglow.functions.numbering import SMALL
from alpenglow.operators import bitreach, neighbours, squares, structure, walks, wedges
from alpenglow.operators.graph import reach
from alpenglow.plans.cut import written
from alpenglow.plans.landscape import Landscape


def value(df: DataFrame) -> float:
    """The only cell of a one-row table, NaN for null or no row."""
    row = df.first()
    return float("nan") if row is None or row[0] is None else float(row[0])


def _one(land: Landscape, x: float, name: str = "value") -> DataFrame:
    return land.spark.createDataFrame([(None if x is None or math.isnan(x) else float(x),)], f"{name} double")


# ruggedness


def local_optima_ratio(land: Landscape) -> DataFrame:
    return land.optima.agg((F.count_if(F.col("is_lo") & (F.col("node_id") == F.col("peak"))) / F.count(F.lit(1))).alias("value"))


def autocorrelation(land: Landscape, walk_length: int = 20, walk_times: int = 1000, lag: int = 1, seed: int = 0) -> DataFrame:
    """Pooled lag correlation of fitness along random walks on edges, about one grand mean; walks not longer than the lag don't count."""
    steps = walks.random_walks(land, walk_times, walk_length, seed).join(land.nodes.select("node_id", "fitness"), "node_id")
    long = Window.partitionBy("walk")
    kept = written(steps.withColumn("n", F.count(F.lit(1)).over(long)).where(F.col("n") > lag).drop("n"), "walks")
    mean = kept.agg(F.avg("fitness").alias("m"))
    x = F.col("fitness") - F.col("m")
    rows = kept.join(F.broadcast(mean)).withColumn("x", x).withColumn("y", F.lag("x", lag).over(long.orderBy("step")))  # mean: one row
    return rows.agg(F.when(F.sum(F.col("x") * F.col("x")) > 0, F.sum(F.col("x") * F.col("y")) / F.sum(F.col("x") * F.col("x"))).alias("value"))


def edge_correlation(land: Landscape) -> DataFrame:
    """What :func:`autocorrelation` at lag 1 tends to on graphs whose nodes have equally many neighbours: correlation over edges."""
    f = land.nodes.select("node_id", "fitness")
    both = structure.symmetric(land.edges).join(f, "node_id").join(f.select(F.col("node_id").alias("other"), F.col("fitness").alias("g")), "other")
    return both.agg(stats.guarded_corr(F.col("fitness"), F.col("g")).alias("value"))


def gradient_intensity(land: Landscape) -> DataFrame:
    """Mean improvement of an edge over the mean fitness."""
    d, f = land.edges.agg(F.avg("delta_fit").alias("d")), land.nodes.agg(F.avg("fitness").alias("f"))
    return d.join(f).select(F.when(F.col("f") != 0, F.col("d") / F.col("f")).alias("value"))  # one row each


def _additive(land: Landscape):
    """Columns of the additive model: 0/1, one-hot without the first level, or the code of an ordinal."""
    parts = []
    for i, v in enumerate(land.variables):
        parts += [(i, None)] if v.kind in ("boolean", "ordinal") else [(i, k) for k in range(1, v.levels)]

    def design(codes: np.ndarray) -> np.ndarray:
        return np.column_stack([codes[:, i] if k is None else codes[:, i] == k for i, k in parts])

    return design, len(parts)


def r_s_ratio(land: Landscape) -> DataFrame:
    """Roughness over slope: residual RMSE of the additive fit over the mean size of its coefficients."""
    fit = linalg.least_squares(land.nodes, *_additive(land))
    slope = float(np.abs(fit.coefficients).mean())
    return land.spark.createDataFrame([(fit.rmse / slope if slope > 1e-12 else float("inf"),)], "value double")


# robustness


def neutrality(land: Landscape, threshold: float = 0.01) -> DataFrame:
    f = land.nodes.select("node_id", "fitness")
    both = structure.symmetric(land.edges, land.neutral).join(f, "node_id").join(f.select(F.col("node_id").alias("other"), F.col("fitness").alias("g")), "other")
    return both.agg(F.avg((F.abs(F.col("fitness") - F.col("g")) <= threshold).cast("double")).alias("value"))


def evolvability_enhancing_mutations(land: Landscape, epsilon: float = 0.0) -> DataFrame:
    return land.edge_gains.agg(F.avg((F.col("delta_mean_neighbor_fit") > epsilon).cast("double")).alias("value"))


def mutation_effects(land: Landscape, position: str | None = None, test: str = "positive") -> DataFrame:
    """Effects of every pair of alleles at one or all positions over their shared backgrounds.

    ``(position, allele_a, allele_b, median_abs_effect, mean_effect, p_value, significant)``: effects
    are f(a) - f(b); the first is over the sample deviation of fitness, the p-value that of a fair
    coin giving as many effects of the tested sign.
    """
    if test not in ("positive", "negative"):
        raise ParameterError("test is 'positive' or 'negative'")
    names = F.array(*[F.lit(v.name) for v in land.variables])
    pairs = land.hamming.withColumn("position", F.element_at(names, F.col("p") + 1))
    if position is not None:
        if position not in [v.name for v in land.variables]:
            raise ParameterError(f"no position {position!r}")
        pairs = pairs.where(F.col("position") == position)
    effect = F.col("fu") - F.col("fv")
    rows = pairs.groupBy("position", "a", "b").agg(
        F.avg(effect).alias("mean_effect"), F.count(F.lit(1)).alias("n"), F.count_if(effect > 0 if test == "positive" else effect < 0).alias("k")
    )
    medians = selection.median(pairs, ["position", "a", "b"], F.abs(effect)).withColumnRenamed("quantile", "m")
    rows = rows.join(medians, ["position", "a", "b"])
    sd = land.nodes.agg(F.stddev_samp("fitness").alias("sd"))
    rows = rows.join(F.broadcast(sd)).withColumn("p_value", stats.binomial_tail_udf("k", "n"))  # sd: one row
    return rows.select("position", F.col("a").alias("allele_a"), F.col("b").alias("allele_b"), F.when(F.col("sd") > 0, F.col("m") / F.col("sd")).alias("median_abs_effect"), "mean_effect", "p_value", (F.col("p_value") < 0.05).alias("significant"))


# correlation


def fdc(land: Landscape, method: str = "spearman") -> DataFrame:
    return stats.correlation(land.dist_to_go.join(land.nodes.select("node_id", "fitness"), "node_id"), "dist_go", "fitness", method)


def neighbor_fitness_correlation(land: Landscape, method: str = "pearson") -> DataFrame:
    return stats.correlation(land.neighbour_fitness.join(land.nodes.select("node_id", "fitness"), "node_id"), "fitness", "mean_neighbor_fit", method)


def basin_fitness_correlation(land: Landscape, method: str = "spearman") -> DataFrame:
    """Over all members of local optima: greedy basin size against fitness; members other than a plateau's peak have size 0."""
    rows = land.optima.where("is_lo").join(land.nodes.select("node_id", "fitness"), "node_id").join(land.basin_sizes, "node_id", "left")
    return stats.correlation(rows.select("fitness", F.coalesce("size_basin_greedy", F.lit(0)).alias("size")), "size", "fitness", method)


def fitness_flattening_index(land: Landscape, min_len: int = 3) -> DataFrame:
    """Mean over plain climbs to the global optimum of the rank correlation of step number and gain."""
    paths = walks.climb_paths(land.nodes, land.pointers, land.go_index)
    w = Window.partitionBy("start").orderBy("step")
    gains = paths.withColumn("gain", F.col("fitness") - F.lag("fitness").over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("start"))).where((F.col("n") >= min_len) & (F.col("step") > 0))
    rank = F.rank().over(Window.partitionBy("start").orderBy("gain")) + (F.count(F.lit(1)).over(Window.partitionBy("start", "gain")) - 1) / 2
    each = gains.withColumn("r", rank).groupBy("start").agg(stats.guarded_corr(F.col("step").cast("double"), F.col("r")).alias("c"))
    return each.agg(F.avg("c").alias("value"))


# navigability


def _reaches(land: Landscape, targets: list[int] | None = None, accessible: bool = True, among: DataFrame | None = None) -> DataFrame:
    """``(key, dist, n)`` of the nodes that reach each target along improving edges, or along any.

    What all optima, or the best one, are reached from is kept, as several metrics ask for it.
    """
    if among is None and (targets is None or targets == [land.go_index]):
        name = f"_reached_{'all' if targets is None else 'best'}_{accessible}"
        with land.lock:
            if name not in land.__dict__:
                land.__dict__[name] = written(_counted(land, targets, accessible), "reached")
            return land.__dict__[name]
    return _counted(land, targets, accessible, among)


def _counted(land: Landscape, targets: list[int] | None, accessible: bool, among: DataFrame | None = None) -> DataFrame:
    seeds = land.spark.createDataFrame([(t, t) for t in targets], "key long, node long") if targets is not None else land.optima.where("is_lo").select(F.col("node_id").alias("key"), F.col("node_id").alias("node"))
    edges = land.edges.select("src", "dst")
    return bitreach.reach_counts(edges if accessible else edges.union(edges.select("dst", "src")), seeds, "dst", "src", among)


def global_optima_accessibility(land: Landscape) -> DataFrame:
    """Share of configurations from which improving edges lead to the global optimum."""
    return _reaches(land, [land.go_index]).agg((F.sum("n") / F.lit(land.n_configs)).alias("value"))


def _check_optima(land: Landscape, lo: list[int] | None) -> None:
    if lo is not None:
        there = {r[0] for r in land.optima.where("is_lo").where(F.col("node_id").isin(lo)).select("node_id").collect()}
        if wrong := set(lo) - there:
            raise ParameterError(f"{sorted(wrong)} are no local optima")


def local_optima_accessibility(land: Landscape, lo: list[int] | None = None) -> DataFrame:
    _check_optima(land, lo)
    return bitreach.sizes(_reaches(land, lo)).select(F.col("key").alias("node_id"), (F.col("size") / F.lit(land.n_configs)).alias("accessibility"))


def mean_path_length_to_local_optima(land: Landscape, lo: list[int] | None = None, accessible: bool = True, n_samples: float | int | None = None, seed: int = 0) -> DataFrame:
    """``(node_id, mean, variance)`` of the fewest steps to each optimum from where it can be reached.

    ``n_samples`` takes only so many starts (a whole number) or such a share of all (a float up to 1), drawn by ``seed``.
    """
    _check_optima(land, lo)
    among = None
    if n_samples is not None:
        if isinstance(n_samples, bool) or n_samples <= 0 or (isinstance(n_samples, float) and n_samples > 1):
            raise ParameterError("n_samples is a share above 0 and up to 1, or a positive whole number")
        size = max(1, int(n_samples * land.n_configs)) if isinstance(n_samples, float) else min(n_samples, land.n_configs)
        starts = land.nodes.select(F.col("node_id").alias("node")).orderBy(F.xxhash64("node_id", F.lit(seed)), "node_id").limit(size)
        among = written(starts, "starts")
    return bitreach.sizes(_reaches(land, lo, accessible, among)).select(F.col("key").alias("node_id"), "mean", "variance")


def mean_path_length_to_global_optimum(land: Landscape, accessible: bool = True) -> DataFrame:
    return bitreach.sizes(_reaches(land, [land.go_index], accessible)).select("mean", "variance")


def mean_distance_to_local_optima(land: Landscape, lo: list[int] | None = None, kind=None) -> DataFrame:
    """``(node_id, mean_distance)`` of all configurations to each local optimum.

    ``kind`` replaces the distance: a name, a list of them, or a function of two code arrays (which alone compares every pair).
    """
    _check_optima(land, lo)
    chosen = land.optima.where("is_lo") if lo is None else land.optima.where(F.col("node_id").isin(lo))
    targets = chosen.join(land.nodes.select("node_id", "cfg"), "node_id").select(F.col("node_id").alias("lo"), "cfg")
    kind = kind or land.distance_kind()
    if not callable(kind):
        return structure.mean_distances(land.nodes, targets, kind, land.n_vars).withColumnRenamed("lo", "node_id")
    each = land.nodes.select("cfg").join(targets.withColumnRenamed("cfg", "lo_cfg")).select("lo", kind(F.col("cfg"), F.col("lo_cfg")).alias("d"))
    return each.groupBy(F.col("lo").alias("node_id")).agg(F.avg("d").alias("mean_distance"))


def mean_distance_to_global_optimum(land: Landscape, kind=None) -> DataFrame:
    """To the nearest of all best configurations; ``kind`` as above."""
    return (land.dist_to_go if kind is None else land.distances_to_go(kind)).agg(F.avg("dist_go").alias("value"))


# fitness


def fitness_distribution(land: Landscape, cauchy: bool = True) -> DataFrame:
    out = stats.moments(land.nodes, small=land.n_configs <= SMALL)
    return out.withColumn("cauchy_loc", F.lit(stats.cauchy_location(land.nodes))) if cauchy else out


def fitness_effect_distribution(land: Landscape, mutation: tuple) -> DataFrame:
    """``(effect)`` = f(B) - f(A) over all backgrounds that both alleles of ``(A, position, B)`` share."""
    pairs, sign = _mutation(land, mutation)
    return pairs.select((sign * (F.col("fv") - F.col("fu"))).alias("effect"))


def _mutation(land: Landscape, mutation: tuple) -> tuple[DataFrame, int]:
    a, position, b = mutation
    place = {v.name: i for i, v in enumerate(land.variables)}
    if position not in place:
        raise ParameterError(f"no position {position!r}")
    codes = []
    for x in (a, b):
        row = land.nodes.where(F.col(f"`{position}`") == F.lit(x)).select(F.element_at("cfg", place[position] + 1)).first()
        if row is None:
            raise ParameterError(f"{position} has no {x!r}")
        codes.append(row[0])
    low, high = sorted(codes)
    return land.hamming.where((F.col("p") == place[position]) & (F.col("a") == low) & (F.col("b") == high)), 1 if codes[0] == low else -1


# epistasis


def found_squares(land: Landscape, typed: bool = False) -> DataFrame:
    """Squares of the landscape, written once: of all Hamming pairs, or of its neighbours only."""
    typed = typed and land.typed
    name = f"_squares_{typed}"
    with land.lock:
        if name not in land.__dict__:
            pairs = neighbours.hamming_pairs(land.nodes, land.variables, True) if typed else land.hamming
            land.__dict__[name] = written(squares.squares(land.nodes, pairs, land.variables, typed), "squares")
        return land.__dict__[name]


def gamma(land: Landscape) -> DataFrame:
    return squares.gamma_sums(found_squares(land)).select(F.col("gamma").alias("value"))


def gamma_star(land: Landscape) -> DataFrame:
    return squares.gamma_sums(found_squares(land)).select(F.col("gamma_star").alias("value"))


def _spread(effect: Column, sd: Column) -> Column:
    return F.stddev_pop(effect) / (F.lit(math.sqrt(2)) * sd)


def idiosyncratic_index(land: Landscape, mutation: tuple, min_pairs: int = 3) -> DataFrame:
    """Spread of a mutation's effect over backgrounds, in units of fitness's spread times the root of 2."""
    pairs, _ = _mutation(land, mutation)
    sd = value(land.nodes.agg(F.stddev_pop("fitness")))
    e = F.col("fv") - F.col("fu")
    return pairs.agg(F.when((F.count(F.lit(1)) >= min_pairs) & F.lit(sd > 0), _spread(e, F.lit(sd))).alias("value"))


def global_idiosyncratic_index(land: Landscape, min_pairs: int = 3) -> DataFrame:
    """Mean of the index over all allele pairs with enough backgrounds; 0 on a flat landscape."""
    sd = value(land.nodes.agg(F.stddev_pop("fitness")))
    if not sd > 0:
        return _one(land, 0.0)
    e = F.col("fv") - F.col("fu")
    each = land.hamming.groupBy("p", "a", "b").agg(F.count(F.lit(1)).alias("n"), _spread(e, F.lit(sd)).alias("i")).where(F.col("n") >= min_pairs)
    return each.agg(F.avg("i").alias("value"))


def _strength(land: Landscape, end: str, method: str) -> DataFrame:
    means = land.edges.groupBy(F.col(end).alias("node_id")).agg(F.avg("delta_fit").alias("m")).join(land.nodes.select("node_id", "fitness"), "node_id")
    if method == "regression":
        return means.agg(F.when((F.count(F.lit(1)) > 1) & (F.var_pop("fitness") > 0), F.regr_slope("m", "fitness")).alias("value"))
    return stats.correlation(means, "fitness", "m", method)


def diminishing_returns_index(land: Landscape, method: str = "pearson") -> DataFrame:
    return _strength(land, "src", method)


def increasing_costs_index(land: Landscape, method: str = "pearson") -> DataFrame:
    return _strength(land, "dst", method)


def _sampled(found: DataFrame, share: float | None, seed: int) -> DataFrame:
    """A share of the squares by a hash of their nodes, which is the same on every run."""
    if share is None or share >= 1:
        return found
    return found.where(F.pmod(F.xxhash64("n00", "n11", "n01", "n10", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def classify_epistasis(land: Landscape, share: float | None = None, seed: int = 0) -> DataFrame:
    """Shares of magnitude, sign and reciprocal sign epistasis among cycles of four improving edges, and of positive ones.

    Most cycles are two-locus squares. Those among alleles of one position are reciprocal, and
    positive unless minimising, when their fittest node has no predecessor.
    """
    if land.n_edit != 1:
        raise ParameterError("squares need neighbours one edit apart")
    found = squares.classified(_sampled(found_squares(land, True), share, seed), neighbours.neutral_bound(land.epsilon), land.maximize)
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    counts = found.agg(of("magnitude"), of("sign"), of("reciprocal"), F.count_if("whole").alias("whole"), F.count_if(F.coalesce("positive", F.lit(False))).alias("up"))
    rows = counts.join(squares.line_cycles(land.nodes, land.variables, land.epsilon))  # one row each
    rows = rows if share is None else rows.withColumn("n", F.col("n") * share)
    more = F.col("n") if land.maximize else F.lit(0)
    total = F.col("magnitude") + F.col("sign") + F.col("reciprocal") + F.col("n")
    part = lambda x: F.coalesce(F.try_divide(x, total), F.lit(0.0))
    whole = F.col("whole") + more
    positive = F.coalesce(F.try_divide(F.col("up") + more, whole), F.lit(0.0))
    return rows.select(part(F.col("magnitude")).alias("magnitude"), part(F.col("sign")).alias("sign"), part(F.col("reciprocal") + F.col("n")).alias("reciprocal_sign"), positive.alias("positive"), F.when(whole > 0, 1 - positive).otherwise(0.0).alias("negative"))


#: Wedges that a core closes and classifies in a second: 2.5 million more of them took 7 s on 8 cores (l5 of sf0.1 against sf0.01).
WEDGES_A_SECOND = 40_000


def found_wedges(land: Landscape) -> wedges.Wedges:
    """Wedges of the landscape's neighbours, counted once."""
    with land.lock:
        if "_wedges" not in land.__dict__:
            pairs = neighbours.hamming_pairs(land.nodes, land.variables, True) if land.typed else land.hamming
            land.__dict__["_wedges"] = wedges.wedges(pairs)
        return land.__dict__["_wedges"]


def affordable(land: Landscape, budget: float) -> int | None:
    """How many wedges may be drawn in ``budget`` seconds; None if all of them fit."""
    if budget <= 0:
        raise ParameterError("a budget is a positive number of seconds")
    most = max(1_000, int(budget * WEDGES_A_SECOND * land.spark.sparkContext.defaultParallelism))
    return None if found_wedges(land).total <= most else most


def estimate_epistasis(land: Landscape, samples: int | None = None, budget: float | None = None, seed: int = 0) -> DataFrame:
    """:func:`classify_epistasis` from squares drawn at random, with a standard error beside each share.

    ``samples`` wedges are drawn by ``seed``, or as many as ``budget`` seconds allow by the cost model
    (wedges over a rate for all cores); if all fit, the shares are the exact ones and their errors 0.
    ``wedges`` is the exact count, ``squares`` how many of the drawn (or all) ones are classified.
    Cycles within one position are counted exactly and added at their weight.
    """
    if land.n_edit != 1:
        raise ParameterError("squares need neighbours one edit apart")
    if (samples is None) == (budget is None) or (samples is not None and samples < 1):
        raise ParameterError("give either a positive number of samples or a budget")
    found = found_wedges(land)
    samples = samples if samples is not None else affordable(land, budget)
    drawn = found_squares(land, True) if samples is None else wedges.drawn_squares(land.nodes, found, samples, seed)
    bound = neighbours.neutral_bound(land.epsilon)
    of = lambda k: F.count_if(F.col("kind") == k).alias(k)
    rows = squares.classified(drawn, bound, land.maximize)
    counts = rows.agg(of("magnitude"), of("sign"), of("reciprocal"), F.count_if("whole").alias("whole"), F.count_if(F.coalesce("positive", F.lit(False))).alias("up"))
    # a drawn square stands for so many
    each = 1.0 if samples is None else found.total / samples
    rows = counts.join(squares.line_cycles(land.nodes, land.variables, land.epsilon)).withColumn("n", F.col("n") / each)  # one row each
    drawn_all = F.col("magnitude") + F.col("sign") + F.col("reciprocal")
    total, more = drawn_all + F.col("n"), F.col("n") if land.maximize else F.lit(0)
    share = lambda x, of: F.coalesce(F.try_divide(x, of), F.lit(0.0))
    error = lambda x, n, of: F.coalesce(F.sqrt(n * share(x, n) * (1 - share(x, n))) / F.nullif(of, F.lit(0)), F.lit(0.0)) if samples else F.lit(0.0)
    whole = F.col("whole") + more
    positive = share(F.col("up") + more, whole)
    return rows.select(
        share(F.col("magnitude"), total).alias("magnitude"), error(F.col("magnitude"), drawn_all, total).alias("magnitude_error"),
        share(F.col("sign"), total).alias("sign"), error(F.col("sign"), drawn_all, total).alias("sign_error"),
        share(F.col("reciprocal") + F.col("n"), total).alias("reciprocal_sign"), error(F.col("reciprocal"), drawn_all, total).alias("reciprocal_sign_error"),
        positive.alias("positive"), F.when(whole > 0, 1 - positive).otherwise(0.0).alias("negative"), error(F.col("up"), F.col("whole"), whole).alias("positive_error"),
        drawn_all.alias("squares"), F.lit(found.total).alias("wedges"),
    )


def extradimensional_bypass(land: Landscape, share: float | None = None, seed: int = 0) -> DataFrame:
    """Share of reciprocal squares whose fittest node the opposite one still reaches by improving edges, and the mean fewest steps.

    With minimisation the fittest node has no predecessor in the square; the least other node is the start then.
    """
    found = squares.classified(_sampled(found_squares(land, True), share, seed), neighbours.neutral_bound(land.epsilon), land.maximize).where("kind = 'reciprocal'")
    ids = F.array("n00", "n10", "n01", "n11")
    name = {"00": "n00", "10": "n10", "01": "n01", "11": "n11"}
    opposite = {"00": "n11", "10": "n01", "01": "n10", "11": "n00"}
    pick = lambda of: F.coalesce(*[F.when(F.col("top") == k, F.col(c)) for k, c in of.items()])
    top = pick(name)
    least = F.array_min(F.array_remove(ids, top))
    rows = written(found.select(top.alias("to"), F.when(F.col("whole"), pick(opposite)).otherwise(least).alias("key")), "reciprocal")
    ways = reach(land.edges, rows.select("key", F.col("key").alias("node")))
    met = rows.join(ways.withColumnRenamed("node", "to"), ["key", "to"], "left")
    counts = met.agg(F.count(F.lit(1)).alias("squares"), F.count("dist").alias("motifs_with_bypass"), F.avg("dist").alias("average_bypass_length"))
    # cycles within one position have no way: their fittest nodes are neutral to each other
    total = counts.join(squares.line_cycles(land.nodes, land.variables, land.epsilon)).withColumn("total_motifs", F.col("squares") + F.col("n"))
    return total.select(F.coalesce(F.try_divide("motifs_with_bypass", "total_motifs"), F.lit(0.0)).alias("bypass_proportion"), "average_bypass_length", "total_motifs", "motifs_with_bypass")


def _interactions(land: Landscape, order: int) -> list[tuple[tuple[int, int | None], ...]]:
    """Products of up to ``order`` columns of different positions, 0/1 or one-hot without the first level."""
    per = [[(i, 1)] if v.kind == "boolean" else [(i, k) for k in range(1, v.levels)] for i, v in enumerate(land.variables)]
    return [t for n in range(1, order + 1) for chosen in combinations(per, n) for t in product(*chosen)]


def higher_order_epistasis(land: Landscape, order: int = 2) -> DataFrame:
    """R2 of the fit by all products of up to ``order`` columns of different positions."""
    if not isinstance(order, int) or isinstance(order, bool) or not 1 <= order <= land.n_vars:
        raise ParameterError(f"order must be an integer from 1 to {land.n_vars}")
    terms = _interactions(land, order)
    # one more position, always 1, fills terms up to the same number of factors
    at = np.array([[i for i, _ in t] + [land.n_vars] * (order - len(t)) for t in terms])
    code = np.array([[k for _, k in t] + [1] * (order - len(t)) for t in terms])

    def design(codes: np.ndarray) -> linalg.Sparse:
        wide = np.column_stack((codes, np.ones(len(codes), codes.dtype)))
        rows, columns = np.nonzero(np.logical_and.reduce([wide[:, at[:, j]] == code[:, j] for j in range(order)]))
        return linalg.Sparse(rows, columns, np.ones(len(rows)), codes.shape[0], len(terms))

    return _one(land, linalg.least_squares(land.nodes, design, len(terms)).r2)


def walsh_hadamard(land: Landscape, max_order: int = 2, max_cells: float = 1e9) -> DataFrame:
    """``(order, positions, term, coefficient)``: effects averaged over backgrounds, on the ensemble matrix.

    Complete grids are transformed, whatever their size and order; others are fitted by least squares.

    A term fixes some positions to given other letters than the wild type's (zeros, or the first
    node's). Its entry for a configuration that carries e of its k letters is (-1)^(k-e), times
    s-1 for each position carried, over the product of all s, the letters seen at a position.
    """
    wild = [0] * land.n_vars if land.kind == "boolean" else list(land.nodes.where("node_id = 0").select("cfg").first()[0])
    seen = land.nodes.select(F.posexplode("cfg").alias("p", "a")).groupBy("p").agg(F.array_sort(F.collect_set("a")).alias("s")).collect()
    letters = {r["p"]: list(r["s"]) for r in seen}
    if math.prod(map(len, letters.values())) == land.n_configs and all(wild[i] in letters[i] for i in letters):
        return _walsh_rows(land, transform.ensemble(land.nodes, [letters[i] for i in range(land.n_vars)], wild), wild, max_order)
    per = [[(i, k) for k in letters[i] if k != wild[i]] for i in range(land.n_vars)]
    n_terms = _count_terms([len(x) for x in per], max_order)
    if n_terms * land.n_configs > max_cells:
        raise ParameterError(f"{n_terms} terms by {land.n_configs} configurations are over max_cells")
    terms = [t for n in range(0, min(max_order, land.n_vars) + 1) for chosen in combinations(per, n) for t in product(*chosen)]

    def design(codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), len(terms)))
        for j, t in enumerate(terms):
            for i, k in t:
                s = len(letters[i])
                out[:, j] *= np.where(codes[:, i] == k, s - 1, -1) / s
        return out

    fit = linalg.least_squares(land.nodes, design, len(terms), intercept=False)
    rows = [([dict(t).get(i, -1) for i in range(land.n_vars)], float(c)) for t, c in zip(terms, fit.coefficients)]
    return _walsh_rows(land, land.spark.createDataFrame(rows, "term array<int>, coefficient double"), wild, max_order)


def _count_terms(per: list[int], order: int) -> int:
    """Products of up to ``order`` of these many columns of different positions, counted, not laid out."""
    counts = [1] + [0] * order
    for n in per:
        for k in range(order, 0, -1):
            counts[k] += counts[k - 1] * n
    return sum(counts)


def _walsh_rows(land: Landscape, found: DataFrame, wild: list[int], max_order: int) -> DataFrame:
    """Terms ``(term, coefficient)``, an array with -1 where it fixes no letter, with their order and names."""
    letter = (lambda c: F.element_at(F.array(*[F.lit(x) for x in land.alphabet]), c + 1)) if land.alphabet else (lambda c: F.char(c + 48))
    base = F.array(*[F.lit(w) for w in wild])
    at = F.filter(F.transform("term", lambda x, i: F.struct(i.alias("i"), x.alias("k"))), lambda t: t["k"] >= 0)
    rows = found.withColumn("at", at).where(F.size("at") <= max_order)
    name = F.transform("at", lambda t: F.concat(letter(F.get(base, t["i"])), F.lit("_"), t["i"] + 1, F.lit("_"), letter(t["k"])))
    places = F.array_join(F.transform("at", lambda t: (t["i"] + 1).cast("string")), ",")
    return rows.select(F.size("at").alias("order"), places.alias("positions"), F.array_join(name, "-").alias("term"), "coefficient").orderBy("order", "term")
