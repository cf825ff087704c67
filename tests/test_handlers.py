import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from alpenglow.errors import DataError, ParameterError
from alpenglow.operators import graph, neighbours
from alpenglow.plans.landscape import build
from alpenglow.sources.handlers import Handlers, InputHandler


def halves(batch):
    s = batch.column(0).to_pylist()
    return pa.RecordBatch.from_arrays([pa.array([x[:1] for x in s]), pa.array([int(x[1:]) for x in s], pa.int32())], names=["letter", "number"])


HALVES = InputHandler(halves, {"letter": "categorical", "number": "ordinal"}, {"letter": "string"})


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(f"{a}{n}", float(i)) for i, (a, n) in enumerate(itertools.product("xyz", range(4)))], "s string, fitness double")


def test_registries_are_apart():
    a, b = Handlers(), Handlers()
    a.register("halves", HALVES)
    assert "halves" in a and "halves" not in b and a["halves"] is HALVES
    with pytest.raises(ParameterError):
        a.register("other", halves)


def test_a_kind_of_ones_own(spark, rows):
    known = Handlers()
    known.register("halves", HALVES)
    land = build(rows, kind="halves", handlers=known)
    plain = build(rows.select(F.substring("s", 1, 1).alias("letter"), F.substring("s", 2, 1).cast("int").alias("number"), "fitness"), HALVES.kinds)
    assert land.kind == "halves" and sorted(map(tuple, land.edges.collect())) == sorted(map(tuple, plain.edges.collect()))
    with pytest.raises(ParameterError):
        build(rows, kind="halves")  # no such kind here


def test_analyze_is_asked_for_the_variables(spark, rows):
    asked = []

    def analyze(types):
        asked.append(types)
        return HALVES.kinds, HALVES.types

    known = Handlers()
    known.register("halves", InputHandler(halves, analyze=analyze))
    land = build(rows.withColumn("n", F.monotonically_increasing_id()), kind="halves", handlers=known, ordinal="n")
    assert asked == [{"s": "string"}] and land.n_configs == 12


@pytest.mark.parametrize("bad", [
    InputHandler(halves), InputHandler(halves, {"letter": "no kind"}), InputHandler(halves, {"fitness": "ordinal"}), InputHandler(halves, {"gone": "ordinal"}),
    InputHandler(lambda b: halves(b).slice(1), HALVES.kinds, HALVES.types),
])
def test_handlers_that_break_their_word(spark, rows, bad):
    known = Handlers()
    known.register("bad", bad)
    with pytest.raises(Exception, match="handler"):
        build(rows, kind="bad", handlers=known)


def test_empty_input_is_no_row(spark, rows):
    known = Handlers()
    known.register("halves", HALVES)
    with pytest.raises(DataError):
        build(rows.limit(0), kind="halves", handlers=known)


def test_generators_of_tuples_and_of_matrices(spark):
    """A ring: codes one apart, the last next to the first."""
    df = spark.createDataFrame([(c, d, float(c * 3 + d)) for c in range(7) for d in range(3)], "c int, d int, fitness double")

    def one(cfg):
        return [((cfg[0] + 1) % 7, cfg[1]), (cfg[0], 1 - cfg[1])]

    def many(codes):
        right = codes.copy()
        right[:, 0] = (right[:, 0] + 1) % 7
        flip = codes.copy()
        flip[:, 1] = 1 - flip[:, 1]
        return np.r_[np.arange(len(codes)), np.arange(len(codes))], np.concatenate((right, flip))

    many.batches = True
    kinds = {"c": "ordinal", "d": "ordinal"}
    a, b = (build(df, kinds, generate=g) for g in (one, many))
    assert sorted(map(tuple, a.edges.collect())) == sorted(map(tuple, b.edges.collect())) and a.n_edges == 21 + 7
    none = lambda codes: (np.zeros(0, int), np.zeros((0, 2), int))
    none.batches = True
    assert neighbours.generated_pairs(a.nodes, none).count() == 0


@pytest.mark.parametrize("cycles", [False, True])
def test_pagerank_by_residuals_against_a_solve(spark, cycles):
    rng = np.random.default_rng(3)
    n = 40
    edges = {(int(a), int(b)) for a, b in rng.integers(0, n, (120, 2)) if (a != b if cycles else a < b)}
    w = {e: float(rng.random() + 0.1) for e in edges}
    m = np.zeros((n, n))
    for (a, b), x in w.items():
        m[b, a] = x
    out = m.sum(axis=0)
    m = np.where(out > 0, m / np.where(out > 0, out, 1), 1 / n)
    want = np.linalg.solve(np.eye(n) - 0.85 * m, np.full(n, 0.15 / n))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "node_id long")
    e = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, delta_fit double")
    got = dict(map(tuple, graph.pagerank(nodes, e, limit=0, tolerance=1e-6).collect()))
    assert sum(abs(got[i] - want[i]) for i in range(n)) < 1e-6 and sum(got.values()) == pytest.approx(1)
    assert dict(map(tuple, graph.pagerank(nodes, e.limit(0), limit=0).collect())) == pytest.approx(dict.fromkeys(range(n), 1 / n))
