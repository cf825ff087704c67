"""Numpy versions of the graph loops, for graphs that a size check finds small.

A graph of up to ``LIMIT`` edges is brought to the driver by one job whose result has that bound;
the loops of :mod:`alpenglow.operators.graph` and :mod:`alpenglow.operators.components` go on for
larger ones. Both give the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Edges of a graph, and cells of a table of sources by nodes, that are worked on outside Spark.
LIMIT, CELLS = 20_000, 20_000_000


def fetch(df: DataFrame, limit: int | None = None) -> list[np.ndarray] | None:
    """Columns of ``df`` if it has at most ``limit`` rows (by default ``LIMIT``)."""
    limit = LIMIT if limit is None else limit
    if limit <= 0:
        return None
    table = df.limit(limit + 1).toArrow()
    return None if table.num_rows > limit else [c.to_numpy() for c in table.columns]


def frame(df: DataFrame, **columns: np.ndarray) -> DataFrame:
    """A DataFrame of arrays in the session of ``df``."""
    return df.sparkSession.createDataFrame(pa.table({k: pa.array(v) for k, v in columns.items()}))


class Adjacency:
    """Out-neighbours of nodes given by any ids."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, others: np.ndarray):
        self.ids = np.unique(np.concatenate((src, dst, others)))
        s, d = np.searchsorted(self.ids, src), np.searchsorted(self.ids, dst)
        order = np.argsort(s, kind="stable")
        self.to = d[order]
        self.at = np.searchsorted(s[order], np.arange(len(self.ids) + 1))

    def place(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ids, ids)

    def step(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into nodes, neighbour) of all their out-edges."""
        n = self.at[nodes + 1] - self.at[nodes]
        own = np.repeat(np.arange(len(nodes)), n)
        inside = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
        return own, self.to[self.at[nodes][own] + inside]


def reach(src: np.ndarray, dst: np.ndarray, key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(key, node, dist) of all nodes reached from each key's seeds; None if sources by nodes are too many."""
    g = Adjacency(src, dst, node)
    keys, k = np.unique(key, return_inverse=True)
    n = len(g.ids)
    if len(keys) * n > CELLS:
        return None
    dist = np.full(len(keys) * n, -1, np.int32)
    front = np.unique(k * n + g.place(node))
    level = 0
    while len(front):
        dist[front] = level
        own, to = g.step(front % n)
        new = np.unique(front[own] // n * n + to)
        front = new[dist[new] < 0]
        level += 1
    got = np.flatnonzero(dist >= 0)
    return keys[got // n], g.ids[got % n], dist[got]


def follow(node: np.ndarray, to: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, end of its chain, steps)."""
    order = np.argsort(node)
    ids, t = node[order], np.searchsorted(node[order], to[order])
    steps = np.where(t == np.arange(len(t)), 0, cost[order]).astype(np.int64)
    while True:
        beyond = t[t]
        if np.array_equal(beyond, t):
            return ids, ids[t], steps
        steps = steps + np.where(t == np.arange(len(t)), 0, steps[t])
        t = beyond


def components(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component)."""
    ids = np.unique(np.concatenate((u, v)))
    a, b = np.searchsorted(ids, u), np.searchsorted(ids, v)
    label = np.arange(len(ids))
    while True:
        la, lb = label[a], label[b]
        if np.array_equal(la, lb):
            return ids, ids[label]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(up := label[label], label):
            label = up


def pagerank(nodes: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, damping: float, tolerance: float, rounds: int) -> np.ndarray:
    n = len(nodes)
    s, d = np.searchsorted(nodes, src), np.searchsorted(nodes, dst)
    total = np.bincount(s, weight, n)
    share, end = weight / total[s], total == 0
    rank = np.full(n, 1.0 / n)
    for _ in range(rounds):
        new = (1 - damping) / n + damping * (np.bincount(d, share * rank[s], n) + rank[end].sum() / n)
        change = np.abs(new - rank).sum()
        rank = new
        if change < tolerance:
            break
    return rank
