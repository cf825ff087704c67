"""Operators that replace pairs, masks and solves by less, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.functions import linalg, plots, selection, stats, transform
from alpenglow.functions.kendall import kendall
from alpenglow.operators import bitreach, graph, nearest, neighbours, walks
from alpenglow.plans import metrics as M
from alpenglow.plans.landscape import build
from alpenglow.sources.ingest import Variable


def rows(df):
    return sorted(map(tuple, df.collect()))


def digraph(seed, n, m):
    rng = random.Random(seed)
    return {(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if a != b}


def steps(edges, seeds, n):
    """{node: fewest steps to it} from the seeds."""
    found, front, level = dict.fromkeys(seeds, 0), set(seeds), 0
    while front:
        level += 1
        front = {b for a, b in edges if a in front} - found.keys()
        found |= dict.fromkeys(front, level)
    return found


def test_reach_counts_against_brute_force(spark, monkeypatch):
    """Three words of keys; no round sends more rows than edges x words."""
    n = 150
    edges = digraph(1, n, 260)
    seeds = [(k, k) for k in range(n)] + [(3, 7), (3, 7), (None, 1)]
    e = spark.createDataFrame(sorted(edges), "src long, dst long")
    s = spark.createDataFrame(seeds, "key long, node long")
    sent, stored = [], bitreach._stored

    def counted(state, kind):
        out, path = stored(state, kind)
        sent.append(out.where("open").count())
        return out, path

    monkeypatch.setattr(bitreach, "_stored", counted)
    got = rows(bitreach.reach_counts(e, s))
    want = {}
    for k in range(n):
        for d in steps(edges, {k, 7} if k == 3 else {k}, n).values():
            want[k, d] = want.get((k, d), 0) + 1
    assert got == sorted((k, d, c) for (k, d), c in want.items())
    assert max(sent) <= len(edges) * 3 + n
    among = spark.createDataFrame([(i,) for i in range(0, n, 3)], "node long")
    some = {}
    for k in range(n):
        for node, d in steps(edges, {k, 7} if k == 3 else {k}, n).items():
            if node % 3 == 0:
                some[k, d] = some.get((k, d), 0) + 1
    assert rows(bitreach.reach_counts(e, s, among=among)) == sorted((k, d, c) for (k, d), c in some.items())
    assert bitreach.reach_counts(e, s.limit(0)).count() == 0
    assert rows(bitreach.reach_counts(e.limit(0), s)) == sorted((k, 0, 2 if k == 3 else 1) for k in range(n))


def test_sizes_equal_those_of_pairs(spark):
    e = spark.createDataFrame(sorted(digraph(2, 60, 150)), "src long, dst long")
    s = spark.createDataFrame([(k, k) for k in range(0, 60, 2)], "key long, node long")
    pairs = graph.reach(e, s).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.avg("dist").alias("m"), F.var_pop("dist").alias("v"))
    for a, b in zip(rows(bitreach.sizes(bitreach.reach_counts(e, s))), rows(pairs)):
        assert a == pytest.approx(b)


VARIABLES = [Variable("a", "categorical", 3), Variable("b", "ordinal", 4), Variable("c", "ordinal", 5), Variable("d", "boolean", 2)]
KINDS = ("hamming", "manhattan", [v.kind for v in VARIABLES])


def gap(kind, x, y):
    kinds = {"hamming": ["-"] * 4, "manhattan": ["ordinal"] * 4}[kind] if isinstance(kind, str) else kind
    return sum(abs(a - b) if k == "ordinal" else int(a != b) for a, b, k in zip(x, y, kinds))


@pytest.mark.parametrize("kind", KINDS, ids=str)
def test_nearest_target_by_all_ways(spark, kind):
    rng = random.Random(6)
    cfgs = [c for c in itertools.product(range(3), range(4), range(5), range(2)) if rng.random() < 0.6]
    targets = [c for c in cfgs if rng.random() < 0.2]
    nodes = spark.createDataFrame([(i, list(c)) for i, c in enumerate(cfgs)], "node_id long, cfg array<int>")
    goal = spark.createDataFrame([(list(c),) for c in [*targets, targets[0]]], "cfg array<int>")
    want = [(i, min(gap(kind, c, t) for t in targets)) for i, c in enumerate(cfgs)]
    kinds = nearest._kinds(kind, 4)
    assert rows(nearest.transform(nodes, goal, kinds, VARIABLES, "d")) == want
    assert rows(nearest.by_levels(nodes, goal, kinds, VARIABLES, "d")) == want
    assert rows(nearest.nearest(nodes, goal, kind, VARIABLES)) == want
    assert nearest.nearest(nodes, goal.limit(0), kind, VARIABLES).count() == 0


def test_half_of_a_landscape_ties(spark):
    """No cross join or nested loop is planned, a function of one's own included."""
    rng = random.Random(8)
    cfgs = list(itertools.product(range(3), range(6), range(8)))
    f = [float(rng.random() < 0.5) for _ in cfgs]
    df = spark.createDataFrame([(*c, x) for c, x in zip(cfgs, f)], "a int, b int, c int, fitness double")
    land = build(df, {"a": "categorical", "b": "ordinal", "c": "ordinal"})
    best = [c for c, x in zip(cfgs, f) if x == 1]
    d = lambda x, y: int(x[0] != y[0]) + abs(x[1] - y[1]) + abs(x[2] - y[2])
    want = [(i, min(d(c, t) for t in best)) for i, c in enumerate(cfgs)]
    assert rows(land.dist_to_go) == want
    own = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.abs(p - q)), F.lit(0), lambda s, v: s + v)
    assert rows(land.distances_to_go(own)) == [(i, min(sum(abs(p - q) for p, q in zip(c, t)) for t in best)) for i, c in enumerate(cfgs)]
    plan = land.dist_to_go._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("n_edit,hot", [(1, 2000), (2, 2000), (3, 5), (4, 1)])
def test_pairs_by_segments_against_brute_force(spark, n_edit, hot):
    rng = random.Random(n_edit)
    cfgs = sorted({tuple(rng.choice([0, 0, 1, 2]) if i > 7 else 0 if rng.random() < 0.8 else 1 for i in range(20)) for _ in range(150)})
    df = spark.createDataFrame([(i, list(c), float(i)) for i, c in enumerate(cfgs)], "node_id long, cfg array<int>, fitness double")
    want = [(i, j) for i, j in itertools.combinations(range(len(cfgs)), 2) if sum(a != b for a, b in zip(cfgs[i], cfgs[j])) <= n_edit]
    assert rows(neighbours.segment_pairs(df, 20, n_edit, hot).select("u", "v")) == want
    variables = [Variable(f"v{i}", "categorical", 3) for i in range(20)]
    assert rows(neighbours.edit_pairs(df, variables, n_edit).select("u", "v")) == want


def test_segments_shorter_than_edits(spark):
    df = spark.createDataFrame([(i, list(c), 0.0) for i, c in enumerate(itertools.product(range(3), repeat=3))], "node_id long, cfg array<int>, fitness double")
    for hot in (1, 2000):
        got = rows(neighbours.segment_pairs(df, 3, 2, hot).select("u", "v"))
        assert len(got) == len(set(got)) == 27 * (6 + 12) // 2


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """A small file of rows that joins explode is small by Spark's estimates, and was broadcast with all its keys."""
    spark.range(200).selectExpr("id as node_id", "cast(id as double) as fitness", "transform(sequence(0, 11), i -> cast(shiftright(id, i) & 1 as int)) as cfg").write.parquet(f"{tmp_path}/nodes")
    nodes, variables = spark.read.parquet(f"{tmp_path}/nodes"), [Variable(f"v{i}", "boolean", 2) for i in range(12)]
    found = {"hamming": neighbours.hamming_pairs(nodes, variables), "masks": neighbours.edit_pairs(nodes, variables, 1).select("u", "v"), "segments": neighbours.edit_pairs(nodes, variables, 4).select("u", "v")}
    for name, pairs in found.items():
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and (name == "segments" or "Broadcast" not in plan), name
    want = sum((i ^ j).bit_count() <= 4 for i, j in itertools.combinations(range(200), 2))
    assert found["segments"].count() == want


def test_segments_of_many_positions_and_levels(spark):
    """70 positions are two words of bits, 20 levels five planes."""
    rng = random.Random(5)
    base = [rng.randrange(20) for _ in range(70)]
    cfgs = [[rng.randrange(20) if rng.random() < 0.02 else x for x in base] for _ in range(80)]
    df = spark.createDataFrame([(i, c, 0.0) for i, c in enumerate(cfgs)], "node_id long, cfg array<int>, fitness double")
    want = [(i, j) for i, j in itertools.combinations(range(80), 2) if sum(a != b for a, b in zip(cfgs[i], cfgs[j])) <= 2]
    assert want and rows(neighbours.segment_pairs(df, 70, 2, 3).select("u", "v")) == want


@pytest.mark.parametrize("sizes", [[2] * 7, [3, 2, 4], [40, 2, 3]])
def test_transform_equals_a_solve(spark, sizes):
    rng = np.random.default_rng(2)
    letters = [list(range(s)) for s in sizes]
    wild = [s // 2 for s in sizes]
    cells = list(itertools.product(*letters))
    f = rng.normal(size=len(cells))
    df = spark.createDataFrame([(list(c), float(x)) for c, x in zip(cells, f)], "cfg array<int>, fitness double")
    got = {tuple(r.term): r.coefficient for r in transform.ensemble(df, letters, wild).collect()}
    terms = list(itertools.product(*[[-1, *[k for k in x if k != w]] for x, w in zip(letters, wild)]))
    design = np.array([[np.prod([1 if k == -1 else ((len(x) - 1) if c == k else -1) / len(x) for c, k, x in zip(cell, t, letters)]) for t in terms] for cell in cells])
    want = np.linalg.solve(design, f)
    assert got.keys() == set(terms) and np.allclose([got[t] for t in terms], want)


def test_walsh_of_a_cube_beyond_the_limit_of_terms(spark):
    """2^13 coefficients, which a solve of at most 4,000 terms can't give; each is a signed mean."""
    n, rng = 13, np.random.default_rng(3)
    f = rng.normal(size=1 << n)
    df = spark.createDataFrame([(format(i, f"0{n}b"), float(x)) for i, x in enumerate(f)], "s string, fitness double")
    got = M.walsh_hadamard(build(df, kind="boolean"), max_order=n).collect()
    assert len(got) == 1 << n
    bits = np.array([[int(b) for b in format(i, f"0{n}b")] for i in range(1 << n)])
    for r in random.Random(1).sample(got, 60):
        at = [int(p) - 1 for p in r.positions.split(",") if p]
        assert r.order == len(at) and r.coefficient == pytest.approx(2 ** len(at) * np.mean(f * np.prod(2 * bits[:, at] - 1, axis=1)))


@pytest.mark.parametrize("block", [65_536, 7, 1])
def test_kendall_against_brute_force(spark, block):
    """One block, several, and a block a row: the tree counts what is between them."""
    rng = random.Random(block)
    data = [(float(rng.randrange(12)), float(rng.randrange(15))) for _ in range(130)] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(data, "x double, y double")
    kept = data[:-2]
    sign = lambda v: (v > 0) - (v < 0)
    pairs = list(itertools.combinations(kept, 2))
    top = sum(sign(a[0] - b[0]) * sign(a[1] - b[1]) for a, b in pairs)
    tau = top / (sum(a[0] != b[0] for a, b in pairs) * sum(a[1] != b[1] for a, b in pairs)) ** 0.5
    assert M.value(kendall(df, "x", "y", block=block)) == pytest.approx(tau)
    assert kendall(df.limit(0), "x", "y").collect() == [(None,)] and kendall(df.limit(1), "x", "y").collect() == [(None,)]
    assert kendall(df.withColumn("y", F.lit(1.0)), "x", "y", block=block).collect() == [(None,)]


@pytest.mark.parametrize("few,sent", [(512, 100_000), (3, 100_000), (1, 0)])
def test_quantiles_of_groups_against_numpy(spark, monkeypatch, few, sent):
    """A hot group, ties, one value, values far apart and next to zero; ranges of few rows are ordered, others narrowed."""
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "SENT", sent)
    monkeypatch.setattr(selection, "STEPS", 8)
    rng = np.random.default_rng(9)
    groups = {"hot": rng.normal(size=700), "ties": rng.integers(0, 3, 90).astype(float), "one": np.array([4.0]), "wide": np.r_[1e-300, 5e-324, 0.0, -1.7e308, 1.7e308, 3.0], None: np.array([1.0, 2.0])}
    data = [(g, float(v)) for g, x in groups.items() for v in x] + [("hot", None), ("ties", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for share in (0.5, 0.3, 1.0):
        got = dict(map(tuple, selection.select(df, ["g"], F.col("v"), share).collect()))
        assert got.keys() == groups.keys()
        for g, x in groups.items():
            assert got[g] == pytest.approx(np.quantile(x, share), rel=1e-12)
    assert selection.median(df, [], F.col("v")).count() == 1 and selection.median(df.limit(0), ["g"], F.col("v")).count() == 0


def test_cauchy_fit_has_no_slope(spark):
    x = np.random.default_rng(4).standard_cauchy(4000) * 3 + 7
    at = stats.cauchy_location(spark.createDataFrame([(float(v),) for v in x], "fitness double"))
    best = max((-np.log(s) * len(x) - np.log1p(((x - at) / s) ** 2).sum(), s) for s in np.linspace(2, 4, 400))[1]
    assert abs(at - 7) < 0.3 and abs((2 * (x - at) / (best**2 + (x - at) ** 2)).sum()) < 1e-1


def test_least_squares_of_ten_thousand_terms(spark):
    """Gradients equal numpy's least-norm fit, with fewer rows than terms too, and with an intercept."""
    rng = np.random.default_rng(5)
    terms, n = 10_000, 300
    codes = rng.integers(0, terms, (n, 3))
    f = rng.normal(size=n)
    df = spark.createDataFrame([([int(v) for v in c], float(y)) for c, y in zip(codes, f)], "cfg array<int>, fitness double")

    def design(c):
        out = np.zeros((len(c), terms))
        for j in range(3):
            np.add.at(out, (np.arange(len(c)), c[:, j]), 1.0 + j)
        return out

    for intercept in (False, True):
        fit = linalg.least_squares(df, design, terms, intercept=intercept)
        x = design(codes)
        shift, mean = (x.mean(axis=0), f.mean()) if intercept else (0, 0)
        want = np.linalg.lstsq(x - shift, f - mean, rcond=1e-11)[0]
        assert np.allclose(fit.coefficients, want, atol=1e-6)
        assert fit.sse == pytest.approx(((f - fit.intercept - x @ want) ** 2).sum(), abs=1e-6)
    small = lambda c: design(c)[:, :40]
    a, b = linalg.least_squares(df, small, 40), linalg.gradients(df, small, 40)
    assert np.allclose(a.coefficients, b.coefficients, atol=1e-7) and a.r2 == pytest.approx(b.r2)


@pytest.mark.parametrize("maximize,epsilon,drop", [(True, 0.0, 0.0), (False, 0.0, 0.3), (True, 0.3, 0.1)])
def test_estimated_shares_lie_within_their_errors(spark, maximize, epsilon, drop):
    rng = random.Random(21)
    cfgs = [c for c in itertools.product(range(4), range(3), range(4), range(2)) if rng.random() >= drop]
    df = spark.createDataFrame([(*c, rng.random() + 0.1 * sum(c)) for c in cfgs], "a int, b int, c int, d int, fitness double")
    kinds = {"a": "categorical", "b": "categorical", "c": "ordinal", "d": "boolean"}
    land = build(df, kinds, maximize=maximize, epsilon=epsilon, keep_isolated=True)
    there, linked = set(cfgs), []
    for x, y in itertools.permutations(cfgs, 2):
        at = [i for i in range(4) if x[i] != y[i]]
        if len(at) == 1 and (y[at[0]] - x[at[0]] == 1 if at == [2] else y[at[0]] > x[at[0]]):
            linked.append((x, at[0], y))
    count = sum(x == z and p < q for (x, p, _), (z, q, _) in itertools.product(linked, linked))
    assert M.found_wedges(land).total == count
    exact, got = M.classify_epistasis(land).first(), M.estimate_epistasis(land, samples=4000, seed=3).first()
    for name in ("magnitude", "sign", "reciprocal_sign", "positive"):
        assert abs(got[name] - exact[name]) <= 3 * got[f"{name}_error"] and got[f"{name}_error"] < 0.05
        assert (got[f"{name}_error"] > 0) == (0 < got[name] < 1)
    assert got == M.estimate_epistasis(land, samples=4000, seed=3).first()
    whole = M.estimate_epistasis(land, budget=1e6).first()  # all fit
    assert [whole[k] for k in exact.asDict()] == pytest.approx(list(exact)) and whole.magnitude_error == 0
    drawn = M.wedges.drawn_squares(land.nodes, M.found_wedges(land), 4000, 3).select("n00", "n10", "n01", "n11").distinct()
    every = M.found_squares(land, True).select("n00", "n10", "n01", "n11")
    assert drawn.subtract(every).count() == 0 and drawn.count() > 0.9 * every.count()
    assert len(there) == land.n_configs


def test_cost_model_and_its_arguments(spark, monkeypatch):
    df = spark.createDataFrame([(*c, float(i * 7 % 11)) for i, c in enumerate(itertools.product(range(3), repeat=4))], "a int, b int, c int, d int, fitness double")
    land = build(df, dict.fromkeys("abcd", "categorical"))
    assert M.affordable(land, 1e9) is None
    monkeypatch.setattr(M, "WEDGES_A_SECOND", 0)
    assert M.affordable(land, 1.0) is None or M.affordable(land, 1.0) == 1000
    for bad in ({}, {"samples": 0}, {"samples": 5, "budget": 1.0}, {"budget": 0.0}):
        with pytest.raises(ParameterError):
            M.estimate_epistasis(land, **bad)


def test_sparse_interactions_beyond_the_solve(spark, monkeypatch):
    rng = np.random.default_rng(7)
    cfgs = [c for c in itertools.product(range(5), range(4), range(6)) if rng.random() < 0.7]
    df = spark.createDataFrame([(*map(int, c), float(rng.normal())) for c in cfgs], "a int, b int, c int, fitness double")
    land = build(df, dict.fromkeys("abc", "categorical"), keep_isolated=True)
    want = M.value(M.higher_order_epistasis(land, 2))
    monkeypatch.setattr(linalg, "TERMS", 10)
    assert M.value(M.higher_order_epistasis(land, 2)) == pytest.approx(want, abs=1e-7)


def test_density_and_curve_against_numpy(spark):
    rng = np.random.default_rng(12)
    cfgs = list(itertools.product(range(3), range(2), range(4)))
    f = rng.normal(size=len(cfgs)) + [c[0] + c[2] for c in cfgs]
    df = spark.createDataFrame([(*map(int, c), float(v)) for c, v in zip(cfgs, f)], "a int, b int, c int, fitness double")
    land = build(df, {"a": "categorical", "b": "boolean", "c": "ordinal"})
    got = plots.fitness_density(land, 50).collect()
    at, h = np.linspace(f.min(), f.max(), 50), f.std(ddof=1) * len(f) ** -0.2
    want = np.exp(-(((f[:, None] - at) / h) ** 2) / 2).sum(axis=0) / (len(f) * h * np.sqrt(2 * np.pi))
    assert np.allclose([r.fitness for r in got], at) and np.allclose([r.density for r in got], want)
    x = np.array([[c[0] == 1, c[0] == 2, c[1], c[2], 1] for c in cfgs], float)
    phi = x @ np.linalg.lstsq(x, f, rcond=None)[0]
    curve = plots.global_epistasis_curve(land, 3, 20).collect()
    points = np.linspace(phi.min(), phi.max(), 20)
    assert np.allclose([r.curve for r in curve], np.polyval(np.polyfit(phi, f, 3), points))
    flat = build(df.withColumn("fitness", F.lit(1.0)), {"a": "categorical", "b": "boolean", "c": "ordinal"})
    assert plots.fitness_density(flat).count() == 0


def test_climbs_from_some_nodes(spark):
    cfgs = list(itertools.product(range(3), range(4), range(3)))
    f = [float((i * 7919) % 101) for i in range(len(cfgs))]
    df = spark.createDataFrame([(*c, x) for c, x in zip(cfgs, f)], "a int, b int, c int, fitness double")
    land = build(df, dict.fromkeys("abc", "categorical"))
    to = {r.node: r.to for r in land.pointers.collect()}
    whole = plots.adaptive_walks(land)
    assert rows(plots.adaptive_walks(land, len(cfgs), 3)) == [pytest.approx(r) for r in rows(whole)]
    some = rows(plots.adaptive_walks(land, 5, 3))
    assert some[0][2] == 5 and some == rows(plots.adaptive_walks(land, 5, 3))
    paths = {}
    starts = spark.createDataFrame([(0,), (7,)], "node_id long")
    for r in sorted(map(tuple, walks.climbs_from(starts, land.nodes, land.pointers).collect())):
        paths.setdefault(r[0], []).append(r[2])
    for s, path in paths.items():
        assert path[0] == s and all(to[a] == b for a, b in zip(path, path[1:])) and to[path[-1]] == path[-1]
    with pytest.raises(ParameterError):
        plots.adaptive_walks(land, 0)
