import math

import numpy as np
import pytest
from pyspark.sql import types as T

from alpenglow.llm import hard_negatives

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])
LOW, HIGH = -(2**63), 2**63 - 1


def plain(rows, step):
    w = {i: ([256 * int(v) if abs(v) > 2**60 else math.floor(256 * v) for v in x], y) for i, x, y in rows}
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    near = lambda s: min(max(s, LOW), HIGH)
    out = []
    for a in sorted(i for i in w if i % step == 0):
        s = {j: dot(w[a][0], w[j][0]) for j in w if j != a}
        best = lambda ids: sorted(ids, key=lambda j: (-s[j], j))  # noqa: B023, E731
        for p in best(j for j in s if w[j][1] == w[a][1])[:5]:
            fit = [j for j in s if w[j][1] != w[a][1] and 50 * s[p] <= 100 * s[j] <= 95 * s[p]]
            out += [(a, p, r, j, near(s[p]), near(s[j])) for r, j in enumerate(best(fit)[:3], 1)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 0.02, 1e6, 1e9, 1e18])
def test_against_brute_force(spark, monkeypatch, scale):
    """Ties, zeros and whole numbers of any size; anchors in several blocks, candidates in several chunks."""
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", 60)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 6)) * scale
    x[20] = x[33] = x[57]
    x[80] = 0
    rows = [(i, [float(v) for v in r], int(y)) for i, (r, y) in enumerate(zip(x, rng.integers(0, 4, 240)))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(2)
    got = hard_negatives.mine(df, df.where("vec_id % 20 = 0"))
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == plain(rows, 20)


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.7, 0.0], 2), (3, [0.7, 0.0], 3), (4, [0.2, 0.0], 2)]
    odd = [(5, None, 1), (6, [None, 1.0], 1), (7, [float("nan"), 1.0], 2), (8, [0.7, 0.0], None), (None, [0.7, 0.0], 2), (9, [float("inf"), 0.0], 2), (10, [0.7], 2)]
    df = spark.createDataFrame([(*r, None) for r in rows + odd], SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, df.where("vec_id = 0")).collect()))
    assert got == [(0, 1, r, n, 65536, 256 * 179) for r, n in ((1, 2), (2, 3), (3, 10))]
    assert hard_negatives.mine(df.limit(0), df).count() == 0 and hard_negatives.mine(df, df.limit(0)).count() == 0


def test_repeated_rows_are_candidates_each(spark):
    df = spark.createDataFrame([(0, [1.0], 1, ""), (1, [1.0], 1, ""), (1, [1.0], 1, ""), (2, [0.8], 2, ""), (2, [0.8], 2, ""), (0, [9.0], 1, "")], SCHEMA)
    got = sorted(map(tuple, hard_negatives.mine(df, df.where("vec_id = 0")).collect()))
    assert got == sorted([(0, 1, r, 2, 65536, 256 * 204) for r in (1, 2)] * 2)
