"""Operator 5: exact top-k by exhaustive term-at-a-time accumulation.

A vector's components, as integers, are the weights of its terms. Each block of candidates is an
inverted list for every term; a block of queries takes the terms one at a time and scatters its
weighted postings into a dense array of scores. Partition selection leaves each block's best, which
are merged within the task and then over all tasks. Query blocks are files in the shared folder that
the executors write and map, so queries never pass the driver; every chunk of candidates is read
once and meets one block of queries after another.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.llm import files, shared
from alpenglow.llm.vectors import matrix, topped, usable

#: Query rows of a file, about.
CHUNK = 16_384
#: Candidates that meet all queries together; candidates and queries of one array of scores.
CANDIDATES, BLOCK, QUERIES = 65_536, 4096, 512
LONG = np.iinfo(np.int64)


def weights(vectors: np.ndarray, scale: int = 256) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python's whole numbers where one doesn't fit into 62 bits."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
    if not x.size or np.abs(x).max() < 2.0**62:
        return x.astype(np.int64)
    big = [scale * int(v) if abs(v) > 2.0**60 else math.floor(v * scale) for v in vectors.ravel().tolist()]
    return np.array([*big, None], object)[:-1].reshape(x.shape)


def postings(w: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each term the rows that have it, and their weights."""
    out = []
    for t in range(w.shape[1]):
        rows = np.flatnonzero(w[:, t])
        out.append((rows, w[rows, t]))
    return out


def _most(w: np.ndarray) -> int:
    return max(int(w.max()), -int(w.min())) if w.size else 0


def accumulate(queries: np.ndarray, lists: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """Scores of n candidates for each query row: 32 or 64 bits wide, or whole numbers of any size where sums may need more."""
    most = _most(queries) * max((_most(w) for _, w in lists), default=0) * max(1, len(lists))
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    scores = np.full((len(queries), n), 0, kind)
    for t, (rows, w) in enumerate(lists[: queries.shape[1]]):
        own = np.flatnonzero(queries[:, t])
        if not len(own) or not len(rows):
            continue
        part = queries[own, t].astype(kind)[:, None] * w.astype(kind)
        if len(own) == len(queries) and len(rows) == n:
            scores += part
        elif len(rows) == n:
            scores[own] += part
        else:
            scores[own[:, None], rows] += part
    return scores


def best(queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query: (place of query, id, score); ties to the smaller id."""
    n, lists, out = len(ids), postings(w), []
    for a in range(0, len(queries), QUERIES):
        scores = accumulate(queries[a : a + QUERIES], lists, n)
        own = ids == query_ids[a : a + QUERIES, None]
        if scores.dtype == object:
            q, at = np.nonzero(~own)
        else:
            scores[own] = np.iinfo(scores.dtype).min  # no score: sums stay above it
            m = min(k, n)
            q, at = np.nonzero((scores >= np.partition(scores, n - m, axis=1)[:, n - m, None]) & ~own)
        out.append(_best_of(q + a, ids[at], scores[q, at] if scores.dtype == object else scores[q, at].astype(np.int64), k))
    return tuple(np.concatenate(x) for x in zip(*out))


def _best_of(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if score.dtype != object:
        q, v, negative = topped(query, ids, -score, k)
        return q, v, -negative
    each = sorted(set(score.tolist()), reverse=True)
    place = {s: i for i, s in enumerate(each)}
    q, v, rank = topped(query, ids, np.array([place[s] for s in score.tolist()], np.int64), k)
    return q, v, np.array([*(each[i] for i in rank.tolist()), None], object)[:-1]


def _order_key(score: int) -> bytes | None:
    """Of a score near or beyond the bounds of 64 bits, bytes that are ordered like the numbers."""
    return (score + (1 << 2111)).to_bytes(264, "big") if abs(score) >= 1 << 62 else None


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k candidates of highest integer inner product.

    Both tables have vec_id and embedding. Vectors that are null or hold null or non-finite
    components take no part; vectors of other lengths count as filled with zeros. Candidates with
    the query's own vec_id are left out; other repeated rows are candidates each. Of query rows
    with one vec_id the one of least components stands. Ties go to the smaller vec_id. All ranks
    are those of the exact scores; a score outside 64 bits is given as the nearest 64-bit number.
    Empty tables, or a query without candidates, give no rows; extra columns are not read.
    """
    spark = candidates.sparkSession
    rows = usable(candidates)
    asked = shared.written(usable(queries).groupBy("vec_id").agg(F.min("vec").alias("vec")), "queries")
    chunks = max(1, -(-asked.count() // CHUNK))
    folder = shared.fresh(spark, "query-blocks")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file a partition; a task that runs again writes the same rows again."""
        held = pa.Table.from_batches(list(batches), schema=pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.float64()))]))
        if held.num_rows:
            name = f"{folder}/{TaskContext.get().partitionId()}"
            files.save(f"{name}-vec.npy", matrix(held.column("vec").combine_chunks()))
            files.save(f"{name}-id.npy", np.asarray(held.column("vec_id")))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()])], names=["block"])

    dealt = asked.repartition(chunks, "vec_id").sortWithinPartitions("vec_id").mapInArrow(save, "block long")
    blocks = sorted(r[0] for r in dealt.collect())  # a number for each CHUNK queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(part: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(part)
            x, ids = weights(matrix(table.column(1).combine_chunks()), scale), np.asarray(table.column(0))
            for b in blocks:
                q, query_ids = weights(np.asarray(files.load(f"{folder}/{b}-vec.npy")), scale), np.asarray(files.load(f"{folder}/{b}-id.npy"))
                found = [best(q, query_ids, ids[a : a + BLOCK], x[a : a + BLOCK], k) for a in range(0, len(ids), BLOCK)]
                place, vec, score = _best_of(*(np.concatenate(c) for c in zip(*found)), k)
                whole = score.tolist()
                near = whole if score.dtype != object else [min(max(s, LONG.min), LONG.max) for s in whole]
                key = [_order_key(s) for s in whole]
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[place], pa.int64()), pa.array(vec, pa.int64()), pa.array(near, pa.int64()), pa.array(key, pa.binary())], names=["query_id", "vec_id", "score", "exact"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CANDIDATES:
                yield from met(held)
                held = []
        if held and sum(b.num_rows for b in held):
            yield from met([b for b in held if b.num_rows])

    found = rows.mapInArrow(run, "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
