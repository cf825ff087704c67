"""Operator 8: approximate nearest neighbours from balanced posting lists.

Centroids come from a size-penalised k-means on a bounded sample. Every vector goes to the list of
its nearest centroid and, if it lies near a boundary, to further ones whose centroids are at most
``1 + overlap`` times as far and not within ``APART`` of that distance of a chosen centroid. A query
finds its centroids by a best-first search of an in-memory neighbour graph, for a block of queries
at a time, and reads the lists whose centroids are within a ratio of the nearest. That ratio is
measured on the sample: the least that finds ``RECALL`` of the sample's own neighbours. So clustered
vectors are pruned hard, and vectors without structure hardly. Long lists are read in shares of
bounded size; blocks of queries are files in the shared folder that the shares' tasks map.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.llm import files, shared
from alpenglow.llm.vectors import matrix, topped, usable

#: Vectors that centroids and ratio are fitted on at most; all are indexed. Of them those that are looked up to fit the ratio.
SAMPLE, PROBED = 20_000, 512
#: Lists for n vectors: PER_ROOT times the root of n, LISTS at most, so the centroids stay small.
PER_ROOT, LISTS = 3, 4096
#: Rows of a share, and query rows of a file or handled together.
SHARE, ASKED, TOGETHER = 4096, 4096, 256
COPIES, OVERLAP, RECALL = 2, 0.01, 0.97
#: Lists that are read first, to bound what the others give.
FIRST = 6
#: Neighbours that the ratio is fitted for.
K = 10
#: A vector's further lists: their centroids are this share of its distance from each other, or more.
APART = 0.45


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1) - 2 * a @ b.T, 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means whose assignment adds to each squared distance a penalty that grows with the list's size."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[np.sort(rng.choice(len(x), k, replace=False))].copy()
    size = np.full(k, len(x) / max(k, 1))
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        for a in range(0, len(x), TOGETHER * 8):
            d = squared(x[a : a + TOGETHER * 8], c)
            near[a : a + len(d)] = np.argmin(d + (size / size.mean() - 1) * 0.1 * d.mean(), axis=1)
        size = 0.5 * size + 0.5 * np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        count = np.bincount(near, minlength=k)
        full = count > 0
        c[full] = total[full] / count[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


@dataclass
class CentroidGraph:
    """Centroids and, for each, its nearest others and a few far ones."""

    centroids: np.ndarray
    links: np.ndarray
    ratio: float = 1.0
    sizes: np.ndarray | None = None  # different vec_ids of each list, once it is filled

    @classmethod
    def build(cls, c: np.ndarray, near: int = 16, far: int = 4) -> CentroidGraph:
        d = squared(c, c)
        np.fill_diagonal(d, np.inf)
        a = np.argsort(d, axis=1, kind="stable")[:, : min(near, max(len(c) - 1, 1))]
        b = np.random.default_rng(3).integers(0, len(c), (len(c), far))
        return cls(c, np.concatenate((a, b), axis=1))

    def within(self, q: np.ndarray, ratio: float, least: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(query, list) of the lists whose centroids are at most ``ratio`` times as far as the nearest one, by best-first search for all queries at once.

        Where these hold fewer than ``least`` vec_ids, as for a query that lies on a centroid, the
        next lists follow until they do or none is left.
        """
        n, m = len(q), len(self.centroids)
        sizes = self.sizes if self.sizes is not None else np.ones(m, np.int64)
        dist, seen, done = np.full((n, m), np.inf), np.zeros((n, m), bool), np.zeros((n, m), bool)
        own = np.arange(n)

        def look(row: np.ndarray, at: np.ndarray) -> None:
            new = np.unique(row[~seen[row, at]] * m + at[~seen[row, at]])
            row, at = new // m, new % m
            seen[row, at] = True
            dist[row, at] = np.sqrt(((self.centroids[at] - q[row]) ** 2).sum(1))

        entry = np.unique(np.linspace(0, m - 1, min(8, m)).astype(int))
        look(np.repeat(own, len(entry)), np.tile(entry, n))
        while True:
            open_ = np.where(seen & ~done, dist, np.inf)
            go = open_ <= (1.1 * ratio) * dist.min(axis=1)[:, None]  # a little farther than asked: near lists may hang on these
            # queries with little at hand go on with the nearest open list, or with one that no link has led to
            short = ~go.any(axis=1) & ((done.sum(axis=1) < 16) | (done @ sizes < least)) & ~done.all(axis=1)
            if short.any():
                rows = np.flatnonzero(short)
                nearest = open_[rows].argmin(axis=1)
                lost = np.isinf(open_[rows, nearest])
                if lost.any():
                    nearest[lost] = (~seen[rows[lost]]).argmax(axis=1)
                    look(rows[lost], nearest[lost])
                go[rows, nearest] = True
            row, at = np.nonzero(go)
            if not len(row):
                break
            done[row, at] = True
            look(np.repeat(row, self.links.shape[1]), self.links[at].ravel())
        order = np.argsort(np.where(done, dist, np.inf), axis=1, kind="stable")
        near = np.take_along_axis(np.where(done, dist, np.inf), order, axis=1)
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        row, k = np.nonzero((near <= ratio * near[:, :1]) | (np.isfinite(near) & (held < least)))
        return row, order[row, k]


def lists_of(x: np.ndarray, c: np.ndarray, copies: int = COPIES, overlap: float = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every vector's lists."""
    d = np.sqrt(squared(x, c))
    near = np.argsort(d, axis=1, kind="stable")[:, : min(4 * copies, len(c))]
    dist = np.take_along_axis(d, near, axis=1)
    between = np.sqrt(squared(c, c))
    chosen = np.zeros(near.shape, bool)
    chosen[:, 0] = True
    for j in range(1, near.shape[1]):
        ok = (dist[:, j] <= (1 + overlap) * dist[:, 0]) & (chosen.sum(1) < copies)
        for i in range(j):
            ok &= ~chosen[:, i] | (between[near[:, j], near[:, i]] > APART * dist[:, j])
        chosen[:, j] = ok
    row, j = np.nonzero(chosen)
    return row, near[row, j]


def fitted_ratio(x: np.ndarray, c: np.ndarray, k: int, recall: float = RECALL) -> float:
    """The least ratio by which some vectors of ``x`` find this share of their k nearest others among ``x``.

    Where ``x`` is a part of all vectors, k is that part of what is asked for.
    """
    some = np.unique(np.linspace(0, len(x) - 1, min(PROBED, len(x))).astype(int))
    need = []
    for a in range(0, len(some), 64):
        own = some[a : a + 64]
        d = squared(x[own], x)
        d[np.arange(len(own)), own] = np.inf
        near = np.argpartition(d, min(k, len(x) - 1) - 1, axis=1)[:, : min(k, len(x) - 1)]
        row, at = lists_of(x[near.ravel()], c)
        to = np.sqrt(squared(x[own], c))
        far = to[row // near.shape[1], at] / np.maximum(to.min(axis=1)[row // near.shape[1]], 1e-300)
        least = np.full(near.size, np.inf)
        np.minimum.at(least, row, far)
        need.append(least)
    return float(np.quantile(np.concatenate(need), recall)) if need and len(x) > 1 else 1.0


@dataclass
class PostingIndex:
    graph: CentroidGraph
    postings: DataFrame  # list int, share int, vec_id long, vec array<double>
    shares: np.ndarray  # of each list


def build(table: DataFrame, recall: float = RECALL) -> PostingIndex | None:
    """Index of all usable, non-zero vectors of ``table``; None if there are none."""
    spark = table.sparkSession
    rows = usable(table, zero=False)
    n = rows.count()
    if not n:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow() if n > SAMPLE else rows.orderBy("vec_id", "vec").toArrow()
    x = np.unique(matrix(sample.column("vec").combine_chunks()), axis=0)
    # a list has three vectors of the sample or more
    graph = CentroidGraph.build(balanced_centroids(x, int(np.clip(PER_ROOT * np.sqrt(n), 8, min(LISTS, max(8, len(x) // 3))))))
    graph.ratio = fitted_ratio(x, graph.centroids, max(1, round(K * len(x) / n)), recall)
    sent = spark.sparkContext.broadcast(graph)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value.centroids
        for whole in batches:
            for a in range(0, whole.num_rows, TOGETHER * 8):
                batch = whole.slice(a, TOGETHER * 8)
                row, at = lists_of(matrix(batch.column(1), c.shape[1])[:, : c.shape[1]], c)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], names=["list", "vec_id", "vec"])

    filled = shared.written(rows.mapInArrow(assign, "list int, vec_id long, vec array<double>"), "postings")
    counts = {r[0]: r[1:] for r in filled.groupBy("list").agg(F.count(F.lit(1)), F.count_distinct("vec_id")).collect()}  # one row a list
    rows_of, graph.sizes = (np.array([counts.get(i, (0, 0))[k] for i in range(len(graph.centroids))], np.int64) for k in (0, 1))
    shares = -(-rows_of // SHARE)
    number = F.element_at(F.lit(shares.tolist()).cast("array<int>"), F.col("list") + 1)
    return PostingIndex(graph, filled.withColumn("share", F.pmod(F.xxhash64("vec_id"), number).cast("int")), shares)


def search(index: PostingIndex, queries: DataFrame, k: int = K, ratio: float | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest vectors found for each query row, its own vec_id left out; ``ratio`` replaces the fitted one."""
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(index.graph)
    folder = shared.fresh(spark, "query-blocks")
    ratio = index.graph.ratio if ratio is None else ratio

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A partition's queries as a file, and their places in it by list; a task that runs again writes the same."""
        g, block = sent.value, TaskContext.get().partitionId()
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("query_id", pa.int64()), ("vec", pa.list_(pa.float64()))]))
        if not held.num_rows:
            return
        q = matrix(held.column("vec").combine_chunks())
        files.save(f"{folder}/{block}-vec.npy", q)
        files.save(f"{folder}/{block}-id.npy", np.asarray(held.column("query_id")))
        q = matrix(held.column("vec").combine_chunks(), g.centroids.shape[1])[:, : g.centroids.shape[1]]
        found = [(row + a, at) for a in range(0, len(q), TOGETHER) for row, at in [g.within(q[a : a + TOGETHER], ratio, 40 * (k + 1))]]
        row, at = (np.concatenate(f) for f in zip(*found))
        head = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])  # a query's lists come nearest first
        rank = np.arange(len(row)) - np.repeat(head, np.diff(np.r_[head, len(row)]))
        key = at * 2 + (rank >= FIRST)
        order = np.argsort(key, kind="stable")
        row, key = row[order], key[order]
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        data = [row[a:b].astype(np.int32).tobytes() for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(key)])]
        yield pa.RecordBatch.from_arrays([pa.array(key[cut] // 2, pa.int32()), pa.array(key[cut] % 2 == 1), pa.array(np.full(len(cut), block)), pa.array(data, pa.binary())], names=["list", "later", "block", "rows"])

    asked = shared.written(usable(queries, zero=False).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("vec")), "queries")
    blocks = max(1, -(-asked.count() // ASKED))
    probes = shared.written(asked.repartition(blocks, "query_id").sortWithinPartitions("query_id").mapInArrow(probe, "list int, later boolean, block long, rows binary"), "probes")
    number = F.element_at(F.lit(index.shares.tolist()).cast("array<int>"), F.col("list") + 1)
    left = probes.withColumn("share", F.explode(F.when(number > 0, F.sequence(F.lit(0), number - 1))))

    def nearest(asked: pa.Table, posted: pa.Table) -> pa.Table:
        """The k nearest of a share for each query that reads it; a vec_id counts once, at its least distance.

        Queries that have a bound, from their first lists, take nothing beyond it.
        """
        out = [(np.zeros(0, np.int64),) * 4 + (np.zeros(0),)]
        b = matrix(posted.column("vec").combine_chunks()) if posted.num_rows else np.zeros((0, 0))
        ids = np.asarray(posted.column("vec_id"))
        order = np.argsort(ids, kind="stable")
        ids, b = ids[order], b[order]
        head = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]][: len(ids)])
        for block, rows in zip(asked.column("block").to_pylist(), asked.column("rows").to_pylist()) if len(ids) else ():
            rows = np.frombuffer(rows, np.int32)
            vec, names = files.load(f"{folder}/{block}-vec.npy"), files.load(f"{folder}/{block}-id.npy")
            bound = files.load(f"{folder}/{block}-bound.npy") if asked.column("later")[0].as_py() else None
            for start in range(0, len(rows), TOGETHER):
                some = rows[start : start + TOGETHER]
                q, q_ids = np.asarray(vec[some]), np.asarray(names[some])
                width = max(q.shape[1], b.shape[1])
                q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m for m in (q, b))
                d = squared(q, x)
                d[q_ids[:, None] == ids] = np.inf
                each = np.minimum.reduceat(d, head, axis=1)
                m = min(k, each.shape[1])
                limit = np.partition(each, m - 1, axis=1)[:, m - 1, None]
                if bound is not None:
                    limit = np.minimum(limit, np.asarray(bound[some])[:, None] ** 2)
                row, at = np.nonzero((d <= limit * (1 + 1e-9) + 1e-12) & np.isfinite(d))  # rounding can't drop a tie
                score = np.sqrt(((q[row] - x[at]) ** 2).sum(1))
                order = np.lexsort((score, ids[at], row))
                row, at, score = row[order], at[order], score[order]
                once = np.r_[True, (row[1:] != row[:-1]) | (ids[at][1:] != ids[at][:-1])][: len(row)]
                row, vec_id, score = topped(row[once], ids[at[once]], score[once], k)
                out.append((q_ids[row], vec_id, np.full(len(row), block), some[row].astype(np.int64), score))
        columns = dict(zip(("query_id", "vec_id", "block", "row", "score"), (np.concatenate(c) for c in zip(*out))))
        return pa.table({c: pa.array(v, pa.float64() if c == "score" else pa.int64()) for c, v in columns.items()})

    def looked_up(asked: DataFrame) -> DataFrame:
        keys = ["list", "share"]
        return asked.groupBy(*keys).cogroup(index.postings.groupBy(*keys)).applyInArrow(nearest, "query_id long, vec_id long, block long, row long, score double")

    # the first lists give every query a bound, beyond which the others needn't give anything
    found = shared.written(looked_up(left.where("not later")), "near")
    near = found.groupBy("block", "row", "vec_id").agg(F.min("score").alias("score"))
    kth = near.withColumn("rank", F.row_number().over(Window.partitionBy("block", "row").orderBy("score", "vec_id"))).where(F.col("rank") == k)

    def bounds(rows: pa.Table) -> pa.Table:
        """A file for each block; a query with fewer than k so far has no bound."""
        block = rows.column("block")[0].as_py()
        bound = np.full(len(files.load(f"{folder}/{block}-id.npy")), np.inf)
        known = rows.filter(rows.column("row").is_valid())
        bound[np.asarray(known.column("row"))] = np.asarray(known.column("score"))
        files.save(f"{folder}/{block}-bound.npy", bound)
        return pa.table({"block": pa.array([block], pa.int64())})

    every = probes.select("block").distinct().select("block", F.lit(None).cast("long").alias("row"), F.lit(None).cast("double").alias("score"))
    kth.select("block", "row", "score").union(every).groupBy("block").applyInArrow(bounds, "block long").count()
    found = found.union(looked_up(left.where("later")))
    # the copies of a vector in several lists have one distance
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(table: DataFrame, queries: DataFrame, k: int = K, ratio: float | None = None) -> DataFrame:
    """:func:`search` over an index of ``table``; both have vec_id and embedding.

    Vectors that are null, zero, or hold null or non-finite components take no part, as candidates
    or queries; shorter vectors count as filled with zeros. Rows that repeat a vec_id give it once,
    at its least distance. Ties go to the smaller vec_id. No vectors give no rows; extra columns
    are not read.
    """
    index = build(table)
    if index is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, queries, k, ratio)
