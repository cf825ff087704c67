import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from alpenglow.errors import DataError, NotBuiltError, ParameterError
from alpenglow.operators import graph, local, neighbours
from alpenglow.operators.components import components
from alpenglow.plans import metrics as M
from alpenglow.plans.filters import RowFilter, Rule, combine_filters, config_values, custom_filter, fitness_threshold
from alpenglow.plans.landscape import Landscape, build
from alpenglow.plans.profile import list_metrics, profile, select
from tests.brute import Brute

KINDS = {"a": "categorical", "b": "boolean", "c": "ordinal"}


def made(spark, seed, maximize=True, epsilon=0.0, values=6, drop=0.0):
    rng = random.Random(seed)
    cfgs = [c for c in itertools.product(range(3), range(2), range(4)) if rng.random() >= drop]
    f = [float(rng.randrange(values)) + (rng.random() if epsilon else 0) for _ in cfgs]
    rows = spark.createDataFrame([(*c, x) for c, x in zip(cfgs, f)], "a int, b int, c int, fitness double")
    land = build(rows, KINDS, maximize=maximize, epsilon=epsilon, keep_isolated=True)
    return land, Brute(cfgs, f, list(KINDS.values()), maximize, epsilon)


@pytest.mark.parametrize("seed,maximize,epsilon,drop", [(1, True, 0.0, 0.0), (2, False, 0.0, 0.2), (3, True, 0.7, 0.0), (4, False, 0.9, 0.1)])
def test_structure_against_brute_force(spark, seed, maximize, epsilon, drop):
    land, want = made(spark, seed, maximize, epsilon, drop=drop)
    assert {(r.src, r.dst) for r in land.edges.collect()} == want.edges
    assert {(r.u, r.v) for r in land.neutral.collect()} == want.neutral
    assert {r.node_id: r.is_lo for r in land.optima.collect()} == {i: want.is_lo(i) for i in range(want.n)}
    assert {r.node_id: (r.basin_index, r.steps) for r in land.basins.collect()} == {i: want.basin(i) for i in range(want.n)}
    peaks = {want.plateau[i] for i in range(want.n) if want.is_lo(i)}
    sizes = {r.node_id: r.size_basin_accessible for r in land.accessible_paths.collect()}
    assert sizes == {i: len(want.ancestors(want.members[i])) if i in peaks else 0 for i in range(want.n)}
    assert M.value(M.gamma(land)) == pytest.approx(want.gamma())
    assert M.value(M.global_idiosyncratic_index(land)) == pytest.approx(want.idiosyncratic())
    assert M.value(M.global_optima_accessibility(land)) == pytest.approx(len(want.ancestors([land.go_index])) / want.n)


def test_loops_in_spark_equal_local_ones(spark):
    land, _ = made(spark, 5, values=4)
    seeds = land.optima.where("is_lo").select(F.col("peak").alias("key"), F.col("node_id").alias("node"))
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(graph.reach(land.edges, seeds, "dst", "src", limit=0)) == rows(graph.reach(land.edges, seeds, "dst", "src"))
    assert rows(graph.follow(land.pointers, limit=0)) == rows(graph.follow(land.pointers))
    assert rows(components(land.neutral)) == rows(components(land.neutral, limit=local.LIMIT))
    a, b = (dict(rows(graph.pagerank(land.nodes, land.edges, limit=k))) for k in (0, local.LIMIT))
    assert all(abs(a[i] - b[i]) < 1e-9 for i in a) and abs(sum(a.values()) - 1) < 1e-9


def test_onemax_anchors(spark):
    n = 5
    rows = spark.createDataFrame([(format(i, f"0{n}b"), float(i.bit_count())) for i in range(1 << n)], "s string, fitness double")
    land = build(rows, kind="boolean")
    assert land.shape == (1 << n, n << (n - 1)) and land.n_lo == 1
    assert M.value(M.gamma(land)) == pytest.approx(1) and M.value(M.fdc(land)) == pytest.approx(-1)
    assert M.value(M.r_s_ratio(land)) == pytest.approx(0, abs=1e-6)
    assert M.mean_path_length_to_global_optimum(land).first()["mean"] == pytest.approx(n / 2)
    classes = M.classify_epistasis(land).first()
    assert classes.magnitude == 1 and classes.positive == 0 and classes.negative == 1
    walsh = {r.term: r.coefficient for r in M.walsh_hadamard(land).collect()}
    assert all(abs(v) < 1e-8 for t, v in walsh.items() if t.count("-")) and walsh["0_1_1"] == pytest.approx(1)
    assert M.value(M.edge_correlation(land)) == pytest.approx(1 - 2 / n)


@pytest.mark.parametrize("f,kind", [((0, 1, 2, 3.5), "magnitude"), ((0, 2, -1, 1), "magnitude"), ((0, 1, -1, 2), "sign"), ((2, 0, 1, 3), "reciprocal_sign")])
def test_square_kinds(spark, f, kind):
    rows = spark.createDataFrame([(c, float(x)) for c, x in zip(("00", "10", "01", "11"), f)], "s string, fitness double")
    got = M.classify_epistasis(build(rows, kind="boolean")).first().asDict()
    assert got[kind] == 1


@pytest.mark.parametrize("epsilon,maximize", [(0.0, True), (0.6, True), (0.0, False)])
def test_cycles_against_brute_force(spark, epsilon, maximize):
    rng = random.Random(12)
    cfgs = list(itertools.product(range(5), range(4)))
    f = [rng.randrange(3) + (rng.random() * 0.5 if epsilon else 0.0) for _ in cfgs]
    rows = spark.createDataFrame([(*c, float(x)) for c, x in zip(cfgs, f)], "a int, b int, fitness double")
    land = build(rows, kind="categorical", epsilon=epsilon, maximize=maximize, keep_isolated=True)
    got = M.classify_epistasis(land).first().asDict()
    want = Brute(cfgs, f, ["categorical"] * 2, maximize, epsilon).cycles()
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_plateau_boundary_is_inclusive(spark):
    rows = spark.createDataFrame([("0", 0.0), ("1", 0.5)], "s string, fitness double")
    land = build(rows, kind="boolean", epsilon=0.5)
    assert land.neutral.count() == 1 and land.edges.count() == 0 and land.n_lo == 1 and len(land.lo_index) == 2


def test_sequences_duplicates_and_invariants(spark):
    rows = spark.createDataFrame([(0, "acA", 1.0), (1, "ACA", 9.0), (2, "AGA", 2.0), (3, "TGA", 3.0)], "ordinal int, seq string, fitness double")
    land = build(rows, kind="dna", ordinal="ordinal")
    assert land.n_configs == 3 and [v.name for v in land.variables] == ["pos_0", "pos_1"]
    assert land[0]["fitness"] == 1.0 and land.n_edges == 2
    with pytest.raises(DataError):
        build(rows, kind="rna", ordinal="ordinal")


def test_more_edits_and_own_neighbours(spark):
    land, want = made(spark, 7)
    two = {(r.u, r.v) for r in neighbours.edit_pairs(land.nodes, land.variables, 2).collect()}
    assert two == {(i, j) for i, j in itertools.combinations(range(want.n), 2) if sum(x != y for x, y in zip(want.cfgs[i], want.cfgs[j])) <= 2}
    flip = lambda c: [(c[0], 1 - c[1], c[2])]
    own = {(r.u, r.v) for r in neighbours.generated_pairs(land.nodes, flip).collect()}
    assert own == {(i, j) for i, j in itertools.combinations(range(want.n), 2) if want.cfgs[i][0] == want.cfgs[j][0] and want.cfgs[i][2] == want.cfgs[j][2]}


def test_filters(spark):
    df = spark.createDataFrame([("ab", 1), ("cd", 2), (None, 3)], "t string, n int")
    keep = lambda f: [r.n for r in f.apply(df).orderBy("n").collect()]
    assert keep(RowFilter((Rule("t", "contains", "^a"),))) == [1]
    assert keep(RowFilter((Rule("n", ">", 1), Rule("zz", "==", 0)))) == [2, 3]
    assert keep(RowFilter((Rule("zz", "==", 0),), "or")) == []
    assert keep(combine_filters([fitness_threshold(3, "==", "n"), config_values({"t": ["ab"]})], "or")) == [1, 3]
    assert keep(custom_filter("n", lambda x: x % 2 == 1)) == [1, 3]
    with pytest.raises(TypeError):
        RowFilter((Rule("n", "contains", "1"),)).apply(df)


def test_errors(spark):
    df = spark.createDataFrame([("0", 1.0), ("1", float("nan"))], "s string, fitness double")
    with pytest.raises(DataError):
        build(df, kind="boolean")
    with pytest.raises(NotBuiltError):
        Landscape().describe()
    with pytest.raises(ParameterError):
        build(df, {"s": "numeric"})
    lonely = spark.createDataFrame([("00", 1.0), ("11", 2.0)], "s string, fitness double")
    with pytest.raises(DataError):
        build(lonely, kind="boolean")


def test_tau_modes(spark):
    rows = spark.createDataFrame([(format(i, "03b"), float(i)) for i in range(8)], "s string, fitness double")
    assert build(rows, kind="boolean", tau=4.0).n_configs == 4
    both = build(rows, kind="boolean", tau=4.0, filter_mode="both")
    assert both.n_configs == 8 and both.n_edges == 8
    with pytest.raises(DataError):
        build(rows, kind="boolean", tau=99.0)


def test_profile_and_selection(spark):
    land, _ = made(spark, 8)
    row = profile(land, groups="epistasis").first().asDict()
    assert "epistasis.sign" in row and "fdc" not in row
    assert {m.name for m in select(include=["fdc", "gamma"], exclude=["gamma"])} == {"fdc"}
    with pytest.raises(ParameterError):
        select(groups=["epistasis"], include=["fdc"])
    assert list_metrics(spark).count() == 22
    assert profile([land, land], include=["local_optima_ratio"]).count() == 2


def test_mutations_and_kendall(spark):
    land, want = made(spark, 9, values=1000)
    effects = sorted(r.effect for r in M.fitness_effect_distribution(land, (0, "a", 2)).collect())
    at = dict(zip(want.cfgs, want.f))
    assert effects == sorted(at[2, b, c] - at[0, b, c] for b in range(2) for c in range(4))
    tau = M.value(M.fdc(land, "kendall"))
    d = {r.node_id: r.dist_go for r in land.dist_to_go.collect()}
    sign = lambda x: (x > 0) - (x < 0)
    pairs = list(itertools.combinations(range(want.n), 2))
    up = sum(sign(d[i] - d[j]) * sign(want.f[i] - want.f[j]) for i, j in pairs)
    assert tau == pytest.approx(up / math.sqrt(sum(d[i] != d[j] for i, j in pairs) * sum(want.f[i] != want.f[j] for i, j in pairs)))


def test_quantiles_without_a_buffer(spark):
    from alpenglow.functions import stats

    rng = random.Random(3)
    values = [float(rng.randrange(40)) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "fitness double")
    exact = df.agg(F.percentile("fitness", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.9)))).first()[0]
    assert stats.quantiles(df, "fitness", (0.25, 0.5, 0.9)) == pytest.approx(exact)
    some = df.where("fitness is not null")
    a, b = stats.moments(some).first(), stats.moments(some, small=False).first()
    assert tuple(a) == pytest.approx(tuple(b))


def test_autocorrelation_nears_edge_correlation(spark):
    n = 6
    rows = spark.createDataFrame([(format(i, f"0{n}b"), float(i.bit_count())) for i in range(1 << n)], "s string, fitness double")
    land = build(rows, kind="boolean")
    assert M.value(M.autocorrelation(land, 20, 600, seed=3)) == pytest.approx(1 - 2 / n, abs=0.08)


def test_network(spark):
    f = [0, 1, 2, 3, 4, 5, 6, 7]
    rows = spark.createDataFrame([(format(i, "03b"), float(x if i != 0 else 7.5)) for i, x in enumerate(f)], "s string, fitness double")
    land = build(rows, kind="boolean")
    peaks = set(land.lo_index)
    assert peaks == {0, 7}
    lon = land.get_lon(min_edge_freq=0, mlon=False)
    basin = {r.node_id: r.basin_index for r in land.basins.collect()}
    want = {}
    for p in peaks:
        for i in range(8):
            if (p ^ i).bit_count() == 2 and basin[i] != p:
                want[p, basin[i]] = want.get((p, basin[i]), 0) + 1
    assert {(r.src, r.dst): r.weight for r in lon.edges.collect()} == want


def test_large_sides_equal_small_ones(spark, monkeypatch):
    """Everything once more with the size checks at 0, as if no graph, table or column were small."""
    from alpenglow.functions import numbering, stats
    from alpenglow.plans import landscape as plan
    from alpenglow.sources import ingest

    def all_of(seed, maximize, epsilon):
        land, _ = made(spark, seed, maximize, epsilon, drop=0.1)
        tables = [land.nodes.select("node_id", "cfg", "fitness"), land.edges, land.neutral, land.plateaus, land.optima, land.basins, land.accessible_paths, land.dist_to_go, land.basin_sizes]
        one = [M.fdc(land), M.fdc(land, method="kendall"), M.fitness_distribution(land), M.fitness_flattening_index(land), M.basin_fitness_correlation(land), M.mean_path_length_to_local_optima(land), M.mean_distance_to_local_optima(land), land.get_lon(min_edge_freq=0).edges]
        near = lambda x: round(x, 8) if isinstance(x, float) else x
        found = [sorted((tuple(map(near, r)) for r in t.collect()), key=str) for t in (*tables, *one)]
        return found, {r.node_id: r.pagerank for r in land.pagerank.collect()}

    for args in ((21, True, 0.0), (22, False, 0.8)):
        small, ranks = all_of(*args)
        with monkeypatch.context() as m:
            for module in (numbering, stats, plan, ingest, M):
                m.setattr(module, "SMALL", 0)
            m.setattr(local, "LIMIT", 0)
            m.setattr(ingest, "LITERAL_LEVELS", 0)
            large, other = all_of(*args)
        assert small == large
        assert all(abs(ranks[k] - other[k]) < 1e-9 for k in ranks)


def test_strategies_distances_and_samples(spark):
    land, want = made(spark, 31, epsilon=0.7)
    for strategy in ("best-improvement", "first-improvement"):
        for exit_by in ("best-improvement", "first-improvement"):
            got = {r.node_id: r.basin_index for r in land.basins_by(strategy, exit_by).collect()}
            peaks = {r.node_id: r.peak for r in land.optima.where("is_lo").collect()}
            assert len(got) == want.n and set(got.values()) <= set(peaks.values()) and all(got[i] == p for i, p in peaks.items())
    same = lambda x: {r.node_id: (r.basin_index, r.steps) for r in x.collect()}
    assert same(land.basins_by()) == same(land.basins)
    with pytest.raises(ParameterError):
        land.basins_by("worst")
    squared = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    gap = lambda i, j: sum((x - y) ** 2 for x, y in zip(want.cfgs[i], want.cfgs[j]))
    best = [i for i in range(want.n) if want.f[i] == max(want.f)]
    assert M.value(M.mean_distance_to_global_optimum(land, squared)) == pytest.approx(sum(min(gap(i, g) for g in best) for i in range(want.n)) / want.n)
    got = {r.node_id: r.mean_distance for r in M.mean_distance_to_local_optima(land, kind=squared).collect()}
    assert got and all(v == pytest.approx(sum(gap(i, k) for i in range(want.n)) / want.n) for k, v in got.items())
    kinds = list(KINDS.values())
    typed = lambda i, j: sum(abs(x - y) if k == "ordinal" else x != y for x, y, k in zip(want.cfgs[i], want.cfgs[j], kinds))
    plain = {"hamming": lambda i, j: sum(x != y for x, y in zip(want.cfgs[i], want.cfgs[j])), "manhattan": lambda i, j: sum(abs(x - y) for x, y in zip(want.cfgs[i], want.cfgs[j])), None: typed}
    for kind, d in plain.items():
        got = {r.node_id: r.mean_distance for r in M.mean_distance_to_local_optima(land, kind=kind).collect()}
        assert got and all(v == pytest.approx(sum(d(i, k) for i in range(want.n)) / want.n) for k, v in got.items())
    whole = {r.node_id: r.mean for r in M.mean_path_length_to_local_optima(land).collect()}
    assert {r.node_id: r.mean for r in M.mean_path_length_to_local_optima(land, n_samples=1.0).collect()} == whole
    assert {r.node_id: r.mean for r in M.mean_path_length_to_local_optima(land, n_samples=10_000).collect()} == whole
    assert M.mean_path_length_to_local_optima(land, n_samples=3).count() <= len(whole)
    for wrong in (0, 1.5, -2, True):
        with pytest.raises(ParameterError):
            M.mean_path_length_to_local_optima(land, n_samples=wrong)


def test_network_measures_in_the_data(spark):
    land, _ = made(spark, 32)
    rows = land.get_data(lo_only=True, network=land.get_lon(min_edge_freq=0))
    net = {r.peak: r for r in land.get_lon(min_edge_freq=0).nodes.collect()}
    peaks = {r.node_id: r.peak for r in land.optima.where("is_lo").collect()}
    got = rows.collect()
    assert got and all((r.lon_accessibility, r.lon_in_degree, r.lon_escape_difficulty) == (net[peaks[r.node_id]].accessibility, net[peaks[r.node_id]].in_degree, net[peaks[r.node_id]].escape_difficulty) for r in got)


def test_variables_called_like_own_columns(spark):
    names = ["cfg", "Node_ID", "peak"]
    rows = [(*c, float(sum(c) * 7 % 5)) for c in itertools.product(range(2), range(3), range(2))]
    land = build(spark.createDataFrame(rows, [*names, "fitness"]), dict(zip(names, ("categorical", "ordinal", "boolean"))))
    plain = build(spark.createDataFrame(rows, ["a", "b", "c", "fitness"]), dict(zip("abc", ("categorical", "ordinal", "boolean"))))
    assert sorted(map(tuple, land.edges.collect())) == sorted(map(tuple, plain.edges.collect()))
    data = land.get_data()
    assert {"cfg_", "Node_ID_", "peak_", "node_id"} <= set(data.columns) and data.count() == 12


def test_queries_see_changed_tables(spark, tmp_path):
    from alpenglow.plans.catalog import landscape

    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    rows.where("l_discount < 0.05").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    first = landscape(spark, str(tmp_path), "l1")
    assert landscape(spark, str(tmp_path), "l1") is first
    rows.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    assert landscape(spark, str(tmp_path), "l1").n_configs > first.n_configs
