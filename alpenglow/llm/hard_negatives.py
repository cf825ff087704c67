"""Operator 12: hard negatives by blocked dense products.

Anchors lie in blocks of bounded size, files of the shared folder that executors write and map;
every chunk of candidates meets one block after another, as a product of two dense float64 matrices.
Components are whole numbers, so the products are exact while their sums stay below 2^53; larger
ones are multiplied as whole numbers of any size. A first pass finds each anchor's best rows of its
own label: a task merges what it finds, an aggregation over all tasks the rest. Their scores bound
the windows of the second pass, whose best rows of other labels are merged in the same way.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from alpenglow.llm import files, shared
from alpenglow.llm.topk import LONG, _order_key, weights
from alpenglow.llm.vectors import matrix, topped, usable

#: Anchors of a file, about; candidates that meet all anchors together; rows of both in one product.
CHUNK, CANDIDATES, BLOCK, ANCHORS = 16_384, 65_536, 4096, 512
EXACT = 1 << 53


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of ``a`` and ``b``, whole numbers: float64 where every sum is exact in it, else of any size."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    most = [max(int(x.max()), -int(x.min())) if x.size else 0 for x in (a, b)]
    if most[0] * most[1] * max(1, width) < EXACT:
        return a.astype(np.float64) @ b.astype(np.float64).T
    return np.dot(a.astype(object), b.astype(object).T)


def best(scores: np.ndarray, valid: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, score) of the k highest valid scores of each row; ties to the smaller id."""
    n = scores.shape[1]
    if scores.dtype == object:
        rows = [heapq.nsmallest(k, ((-s, i) for s, i, v in zip(row, ids.tolist(), ok) if v)) for row, ok in zip(scores.tolist(), valid.tolist())]
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        return at, np.array([i for r in rows for _, i in r], np.int64), np.array([*(-s for r in rows for s, _ in r), None], object)[:-1]
    held = np.where(valid, scores, -np.inf)
    m = min(k, n)
    at, place = np.nonzero(valid & (held >= np.partition(held, n - m, axis=1)[:, n - m, None]))
    row, own, negative = topped(at, ids[place], -held[at, place], k)
    return row, own, -negative


def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k highest of each row, of several results of :func:`best`."""
    kind = object if any(p[2].dtype == object for p in parts) else np.float64
    row, ids = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    score = np.array([*(int(s) for p in parts for s in p[2].tolist()), None], object)[:-1] if kind is object else np.concatenate([p[2] for p in parts])
    if kind is not object:
        r, v, negative = topped(row, ids, -score, k)
        return r, v, -negative
    place = {s: i for i, s in enumerate(sorted(set(score.tolist()), reverse=True))}
    order = {i: s for s, i in place.items()}
    r, v, rank = topped(row, ids, np.array([place[s] for s in score.tolist()], np.int64), k)
    return r, v, np.array([*(order[i] for i in rank.tolist()), None], object)[:-1]


def _shown(score: np.ndarray) -> tuple[list[int], list[bytes | None]]:
    """Scores as the nearest 64-bit numbers, and order-preserving bytes of those near or beyond them."""
    whole = [int(s) for s in score.tolist()]
    return [min(max(s, LONG.min), LONG.max) for s in whole], [_order_key(s) for s in whole]


def _whole(score: int, exact: bytes | None) -> int:
    return score if exact is None else int.from_bytes(exact, "big") - (1 << 2111)


def _saved(rows: DataFrame, chunks: int, folder: str, arrays: Callable[[pa.Table], dict[str, np.ndarray]]) -> list[int]:
    """Numbers of the blocks that executors wrote; a task that runs again writes the same rows again."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            part = TaskContext.get().partitionId()
            for name, array in arrays(pa.Table.from_batches(held)).items():
                files.save(f"{folder}/{part}-{name}.npy", array)
            yield pa.RecordBatch.from_arrays([pa.array([part])], names=["block"])

    dealt = rows.repartition(chunks, "vec_id").sortWithinPartitions("vec_id").mapInArrow(save, "block long")
    return sorted(r[0] for r in dealt.collect())  # a number for each CHUNK anchors


def _loaded(folder: str, block: int, *names: str) -> list[np.ndarray]:
    return [np.asarray(files.load(f"{folder}/{block}-{n}.npy")) for n in names]


def _met(rows: DataFrame, meet: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]], schema: str, scale: int) -> DataFrame:
    """``meet(ids, labels, weights)`` of every chunk of candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            yield from meet(np.asarray(table.column("vec_id")), np.asarray(table.column("label")), weights(matrix(table.column("vec").combine_chunks()), scale))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            if sum(b.num_rows for b in held) >= CANDIDATES:
                yield from flush()
                held = []
        if held:
            yield from flush()
        files.forget()

    return rows.select("vec_id", "label", "vec").mapInArrow(run, schema)


def _ranked(found: DataFrame, by: list[str], rank: str, ids: str, score: str, k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.desc("exact"), ids)
    return found.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(
    candidates: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Both tables have vec_id, embedding and label (whole numbers). Components count as floor(scale * x),
    scores are their inner products, higher first, ties to the smaller vec_id. An anchor's positives
    are its first rows of the same label; for each, the first rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score`` are returned, ranked
    from 1. Rows with a null vec_id, label or vector, or any null or non-finite component, take no part;
    vectors of other lengths count as filled with zeros. Rows with the anchor's own vec_id are
    no candidates for it; other repeated rows are candidates each. Of anchor rows with one vec_id the one of
    least components and label stands. A positive without negatives, an anchor without positives, and
    empty tables give no rows; extra columns are not read. Scores outside 64 bits are ranked and
    compared exactly and given as the nearest 64-bit number.
    """
    spark = candidates.sparkSession
    rows = usable(candidates, also=("label",)).where("label is not null").withColumn("label", F.col("label").cast("long"))
    asked = usable(anchors, also=("label",)).where("label is not null").groupBy("vec_id").agg(F.min(F.struct("vec", F.col("label").cast("long").alias("label"))).alias("m"))
    asked = shared.written(asked.select("vec_id", "m.vec", "m.label"), "anchors")
    chunks = max(1, -(-asked.count() // CHUNK))
    folder = shared.fresh(spark, "anchor-blocks")

    def own(table: pa.Table) -> dict[str, np.ndarray]:
        return {"vec": matrix(table.column("vec").combine_chunks()), "id": np.asarray(table.column("vec_id")), "label": np.asarray(table.column("label"))}

    blocks = _saved(asked, chunks, folder, own)

    def first(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            vec, anchor, label = _loaded(folder, b, "vec", "id", "label")
            found = []
            for kind in np.intersect1d(labels, label):  # a product for each label, as only equal ones count
                left, right = np.flatnonzero(label == kind), np.flatnonzero(labels == kind)
                for i in range(0, len(left), ANCHORS):
                    a = left[i : i + ANCHORS]
                    q = weights(vec[a], scale)
                    for j in range(0, len(right), BLOCK):
                        c = right[j : j + BLOCK]
                        row, vec_id, score = best(products(q, x[c]), anchor[a][:, None] != ids[c], ids[c], positives)
                        found.append((a[row], vec_id, score))
            if found:
                row, vec_id, score = merged(found, positives)
                shown, exact = _shown(score)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[row]), pa.array(vec_id), pa.array(shown, pa.int64()), pa.array(exact, pa.binary())], names=["anchor_id", "positive_id", "positive_score", "exact"])

    near = _met(rows, first, "anchor_id long, positive_id long, positive_score long, exact binary", scale)
    near = _ranked(near, ["anchor_id"], "p", "positive_id", "positive_score", positives)
    each = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score", "exact"))).alias("near"))  # up to `positives` an anchor
    windows = shared.written(asked.join(each, "vec_id"), "windows")
    second = shared.fresh(spark, "window-blocks")

    def bounded(table: pa.Table) -> dict[str, np.ndarray]:
        near = table.column("near").to_pylist()
        flat = [(i, n["positive_id"], n["positive_score"], _whole(n["positive_score"], n["exact"])) for i, each in enumerate(near) for n in each]
        bound = [(-(-low * s // 100), high * s // 100) for *_, s in flat]
        wide = any(abs(x) >= EXACT for pair in bound for x in pair)
        text = lambda k: np.array([str(pair[k]) for pair in bound]) if wide else np.array([pair[k] for pair in bound], np.int64)
        at = np.array([[f[0], f[1], f[2]] for f in flat], np.int64).reshape(-1, 3)
        return own(table) | {"at": at, "low": text(0), "high": text(1)}

    blocks2 = _saved(windows, chunks, second, bounded)

    def windowed(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for b in blocks2:
            vec, anchor, label, at, least, most = _loaded(second, b, "vec", "id", "label", "at", "low", "high")
            if least.dtype.kind == "U":
                least, most = (np.array([*map(int, v.tolist()), None], object)[:-1] for v in (least, most))
            found = []
            for i in range(0, len(vec), ANCHORS):
                part = np.flatnonzero((at[:, 0] >= i) & (at[:, 0] < i + ANCHORS))  # its (anchor, positive)
                q = weights(vec[i : i + ANCHORS], scale)
                # the n-th positive of every anchor at once: one window a row
                nth = np.arange(len(part)) - np.searchsorted(at[part, 0], at[part, 0])
                for j in range(0, len(ids), BLOCK):
                    c = slice(j, j + BLOCK)
                    scores = products(q, x[c])
                    other = (label[i : i + ANCHORS, None] != labels[c]) & (anchor[i : i + ANCHORS, None] != ids[c])
                    for n in range(int(nth.max(initial=-1)) + 1):
                        use = part[nth == n]
                        own_rows = at[use, 0] - i
                        s = scores[own_rows]
                        valid = other[own_rows] & (s >= least[use, None]).astype(bool) & (s <= most[use, None]).astype(bool)
                        row, vec_id, score = best(s, valid, ids[c], negatives)
                        found.append((use[row], vec_id, score))
            if found:
                row, vec_id, score = merged(found, negatives)
                shown, exact = _shown(score)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[at[row, 0]]), pa.array(row), pa.array(at[row, 1]), pa.array(at[row, 2]), pa.array(vec_id), pa.array(shown, pa.int64()), pa.array(exact, pa.binary())],
                    names=["anchor_id", "p", "positive_id", "positive_score", "negative_id", "negative_score", "exact"],
                )

    far = _met(rows, windowed, "anchor_id long, p long, positive_id long, positive_score long, negative_id long, negative_score long, exact binary", scale)
    far = _ranked(far, ["anchor_id", "p"], "rank", "negative_id", "negative_score", negatives)
    return far.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
