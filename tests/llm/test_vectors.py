import math

import numpy as np
import pytest
from pyspark.sql import types as T

from alpenglow.llm import neighbours, topk

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("score", T.StringType())])


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[100] = x[300] = x[700]
    rows = [(i, [float(v) for v in x[i]], "clash") for i in range(1500)]
    odd = [(2000, None, "n"), (2050, [float("nan")] * 16, "n"), (2100, [0.0] * 16, "z"), (2200, [None, 1.0], "n"), (None, rows[0][1], "n"), (2300, [float("inf")] * 16, "n")]
    return spark.createDataFrame(rows + odd, SCHEMA), x.astype(np.float64)


def test_top_k_is_exact(table):
    df, x = table
    w = np.floor(x * 256).astype(int)
    ids = np.r_[np.arange(1500), 2100]
    w = np.vstack((w, np.zeros((1, 16), int)))
    want = set()
    for q in np.flatnonzero(ids % 50 == 0):
        s = w @ w[q]
        best = [j for j in np.lexsort((ids, -s)) if j != q][:5]
        want |= {(int(ids[q]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(best)}
    got = topk.search(df, df.where("vec_id % 50 = 0"))
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and set(map(tuple, got.collect())) == want
    assert topk.search(df.limit(0), df.where("vec_id = 0")).count() == 0


@pytest.mark.parametrize("scale", [1.3e5, 1e6, 1e9, 1e18, 1e300])
def test_top_k_of_large_components(spark, monkeypatch, scale):
    """Whole numbers of any size are ranked exactly; queries come in several blocks, candidates in several chunks."""
    monkeypatch.setattr(topk, "CHUNK", 2)
    monkeypatch.setattr(topk, "CANDIDATES", 100)
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 24)) * scale
    x[5], x[9] = x[100], x[150] * 1e-9
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    w = [[256 * int(v) if abs(v) > 2**60 else math.floor(256 * v) for v in r] for r in x.tolist()]
    want = []
    for q in range(0, 300, 50):
        s = {j: sum(a * b for a, b in zip(w[q], w[j])) for j in range(300) if j != q}
        best = sorted(s, key=lambda j: (-s[j], j))[:5]  # noqa: B023
        want += [(q, r + 1, j, min(max(s[j], -(2**63)), 2**63 - 1)) for r, j in enumerate(best)]
    assert sorted(map(tuple, topk.search(df, df.where("vec_id % 50 = 0")).collect())) == want


def test_many_ties_go_to_the_smallest_ids(spark):
    df = spark.createDataFrame([(i, [0.5, 0.5]) for i in range(9000)], "vec_id long, embedding array<double>").repartition(3)
    got = topk.search(df, df.where("vec_id in (0, 2)"))
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id").collect())) == [(0, r, r) for r in range(1, 6)] + [(2, r, v) for r, v in enumerate((0, 1, 3, 4, 5), 1)]


def test_sparse_rows_scatter():
    rng = np.random.default_rng(2)
    w = rng.integers(-3, 4, (200, 30)) * (rng.random((200, 30)) < 0.2)
    assert np.array_equal(topk.accumulate(w[:7], topk.postings(w), 200), w[:7] @ w.T)


def test_neighbours_recall_and_scores(table):
    df, x = table
    got = neighbours.nearest_neighbours(df, df.where("vec_id % 100 = 0")).collect()
    found = {}
    for r in got:
        assert r.score == np.sqrt(((x[r.query_id] - x[r.vec_id]) ** 2).sum())
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [j for j in np.lexsort((np.arange(1500), d)) if j != q][:10]
        mine = sorted(found[q])
        assert [r for r, *_ in mine] == list(range(1, 11)) and mine == sorted(mine, key=lambda t: t[1:])
        hits += len({j for *_, j in mine} & set(want))
    assert hits >= 0.9 * 150
    assert [j for *_, j in sorted(found[100])][:2] == [300, 700]
    assert neighbours.nearest_neighbours(df.limit(0), df.limit(0)).count() == 0


def brute(x, ids, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    best = {}
    for i, s in zip(ids.tolist(), d.tolist()):
        if i != ids[q]:
            best[i] = min(s, best.get(i, s))
    return sorted(best, key=lambda i: (best[i], i))[:k]


@pytest.mark.parametrize(("share", "asked", "together"), [(4096, 4096, 256), (30, 4, 3)])
def test_clustered_vectors_are_pruned(spark, monkeypatch, share, asked, together):
    """Long lists in several shares, queries in several blocks, rows that repeat a vec_id more than k times."""
    for name, v in (("SHARE", share), ("ASKED", asked), ("TOGETHER", together)):
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(11)
    middle = rng.normal(size=(40, 16)) * 4
    x = middle[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16))
    ids = np.arange(3000)
    x = np.concatenate((x, np.repeat(x[[100]] + 1e-3, 31, axis=0)))
    ids = np.concatenate((ids, np.full(31, 5000)))
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    index = neighbours.build(df)
    asked_ = list(range(0, 3000, 100))
    row, at = index.graph.within(x[asked_], index.graph.ratio, 440)
    assert index.graph.sizes[at].sum() / len(asked_) < 0.3 * 3000
    got = {}
    for r in neighbours.search(index, df.where("vec_id % 100 = 0 and vec_id < 3000")).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    want = {q: brute(x, ids, q) for q in asked_}
    assert all([r for r, _ in sorted(got[q])] == list(range(1, 11)) for q in asked_)
    assert sum(len({v for _, v in got[q]} & set(want[q])) for q in asked_) >= 0.95 * 10 * len(asked_)
    assert sorted(got[100])[0] == (1, 5000)


def test_graph_search_finds_what_a_scan_finds():
    rng = np.random.default_rng(12)
    c = rng.normal(size=(200, 8))
    g = neighbours.CentroidGraph.build(c)
    g.sizes = rng.integers(0, 9, 200)
    q = rng.normal(size=(50, 8))
    row, at = g.within(q, 1.2, 60)
    d = np.sqrt(neighbours.squared(q, c))
    want = {(k, j) for k in range(50) for j in np.flatnonzero(d[k] <= 1.2 * d[k].min()).tolist()}
    assert len(want & set(zip(row.tolist(), at.tolist()))) >= 0.97 * len(want)
    assert all(g.sizes[at[row == k]].sum() >= 60 for k in range(50))
    alone = neighbours.CentroidGraph(c, np.zeros((200, 1), int))  # no links: every list is looked at in turn
    alone.sizes = np.ones(200, int)
    assert len(alone.within(q[:2], 1.0, 10**6)[0]) == 400


def test_fewer_candidates_than_asked(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], "a") for i in range(4)], SCHEMA)
    assert neighbours.nearest_neighbours(df, df.where("vec_id = 0")).count() == 3
    assert topk.search(df, df.where("vec_id = 0")).count() == 3
