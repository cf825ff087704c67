import random

import numpy as np
import pytest

from alpenglow.errors import DataError, ParameterError
from alpenglow.plans.landscape import build
from alpenglow.plans.profile import profile
from alpenglow.sources import assay, ingest, problems, samplers, store


def test_nk_draws_in_counting_order(spark):
    p = problems.NK(5, 2, seed=4)
    rng = random.Random(4)
    linked = [sorted([i, *rng.sample([j for j in range(5) if j != i], 2)]) for i in range(5)]
    values, want = {}, []
    for i in range(32):
        bits, total = [int(c) for c in format(i, "05b")], 0.0
        for k in range(5):
            key = (k, *(bits[j] for j in linked[k]))
            if key not in values:
                values[key] = rng.random()
            total += values[key]
        want.append(total / 5)
    assert [r.fitness for r in p.get_data(spark).orderBy("ordinal").collect()] == want


def test_problems_evaluate(spark):
    got = {r.config: r.fitness for r in problems.Knapsack(5, seed=1).get_data(spark).collect()}
    k = problems.Knapsack(5, seed=1)
    for s, f in got.items():
        w, v = (sum(x for x, c in zip(xs, s) if c == "1") for xs in (k.weights, k.values))
        assert f == (v if w <= k.capacity else 0)
    part = problems.NumberPartitioning(5, 2.0, seed=2)
    for r in part.get_data(spark).collect():
        assert r.fitness == -abs(sum(x if c == "0" else -x for x, c in zip(part.numbers, r.config)))
    sat = problems.Max3Sat(5, 2.0, seed=3)
    for r in sat.get_data(spark).collect():
        assert r.fitness == sum(any((r.config[v] == "1") == want for v, want in c) for c in sat.clauses)
    assert problems.HoC(4, seed=1).get_data(spark).count() == 16
    with pytest.raises(ParameterError):
        problems.NK(3, 3)


class Uniform:
    def ppf(self, u):
        return u

    def rvs(self):
        return 0.5


def test_samplers(spark):
    score = lambda c: float(c["x"])
    grid = samplers.grid_search(spark, {"x": [1, 2], "y": ["a", "b"]}, score)
    assert sorted((r.x, r.y, r.fitness) for r in grid.collect()) == [(1, "a", 1.0), (1, "b", 1.0), (2, "a", 2.0), (2, "b", 2.0)]
    assert samplers.random_search(spark, {"x": [1, 2, 3], "z": Uniform()}, 5, score, seed=1).count() == 5
    lhs = sorted(r.x for r in samplers.latin_hypercube_sampling(spark, {"x": Uniform()}, 8, score, seed=2).collect())
    assert [int(v * 8) for v in lhs] == list(range(8))
    pts = samplers.sobol(16, 4, False, np.random.default_rng(0))
    assert pts[:4, 0].tolist() == [0, 0.5, 0.75, 0.25]
    for d in range(4):
        assert sorted((pts[:, d] * 16).astype(int)) == list(range(16))
    with pytest.raises(ParameterError):
        samplers.grid_search(spark, {"x": 3}, score)


def test_assay(spark):
    assert assay.parse_mutations("A1P:d2n") == [("A", 1, "P"), ("D", 2, "N")]
    with pytest.raises(DataError):
        assay.parse_mutations("A1")
    rows = [(0, "A1P", "PDE", 1.0), (1, "A1P:D2N", "PNE", 2.0), (2, "D2N", "ANE", 3.0), (3, "D2N", "ANE", 9.0), (4, "D2N", "ANE", None), (5, "A1P", "XDE", 0.0)]
    df = spark.createDataFrame(rows, "ordinal int, mutant string, mutated_sequence string, DMS_score double")
    target = assay.infer_target(df)
    assert target == "ADE"
    reduced, positions = assay.reduce_to_mutated_positions(df, target)
    assert positions == [1, 2] and {(r.sequences, r.fitness) for r in reduced.collect()} == {("PD", 1.0), ("PN", 2.0), ("AN", 3.0)}
    record = assay.process_dataset(df, target, lambda land: profile(land, include=["local_optima_ratio"]).first().asDict())
    assert record["status"] == "ok" and record["meta"]["n_mutated_positions"] == 2
    table = assay.assemble_table(spark.createDataFrame([("d", 1.0)], "DMS_id string, x double"), spark.createDataFrame([("d", 0.5, "t")], "DMS_id string, auc double, note string"))
    assert table.columns == ["DMS_id", "x", "zs_auc"]


def test_store_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(format(i, "03b"), float(i % 5)) for i in range(8)], "s string, fitness double")
    land = build(rows, kind="boolean")
    store.save(land, f"{tmp_path}/l")
    back = store.load(spark, f"{tmp_path}/l")
    assert back.describe() == land.describe()
    path = store.to_graphml(land, f"{tmp_path}/g")
    nodes, settings = store.read_graphml(spark, path)
    again = build(nodes.select("ordinal", *land.columns, "fitness"), kind="boolean", ordinal="ordinal")
    assert again.shape == land.shape and settings["maximize"] == "True"


def test_csv_keeps_leading_zeros(spark, tmp_path):
    (tmp_path / "x.csv").write_text("sequences,pos1,fitness\n00,0,1.5\n01,0,2\n10,1,\n11,1,3\n")
    df = ingest.read_csv(spark, str(tmp_path / "x.csv"), "fitness", ["sequences"])
    assert sorted(r.sequences for r in df.collect()) == ["00", "01", "11"]
    assert ingest.infer_alphabet(df, "sequences") == "01"


def test_alphabet_is_the_union_of_all_columns(spark):
    """A letter a column: each gives its letters, whatever the others hold."""
    df = spark.createDataFrame([("P", "P", "Q", 1.0), ("P", "P", "S", 2.0), ("P", "T", "Q", 3.0), (None, "", "Q", 4.0)], "a string, b string, c string, fitness double")
    assert ingest.infer_alphabet(df, ["a", "b", "c"]) == "PQST"
    land = build(df.dropna().where("b <> ''"), kind="sequence")
    assert land.alphabet == "PQST" and land.shape == (3, 2)
    same = build(df.dropna().where("b <> ''"), kind="sequence", alphabet="PQST")
    assert sorted(map(tuple, same.edges.collect())) == sorted(map(tuple, land.edges.collect()))
    whole = build(spark.createDataFrame([("AAC", 1.0), ("AAG", 5.0), ("ACC", 3.0)], "s string, fitness double"), kind="sequence")
    assert whole.alphabet == "ACG"


def test_alphabets_that_cannot_be(spark):
    df = spark.createDataFrame([("ab", "c", 1.0), ("a", "d", 2.0)], "a string, b string, fitness double")
    with pytest.raises(DataError):
        ingest.infer_alphabet(df, ["a", "b"])
    with pytest.raises(DataError):
        ingest.infer_alphabet(df.where("false"), ["a", "b"])
    with pytest.raises(DataError):  # read in upper case, inferred as they are
        build(spark.createDataFrame([("ac", 1.0), ("ag", 5.0)], "s string, fitness double"), kind="sequence")
