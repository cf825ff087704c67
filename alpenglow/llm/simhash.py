"""Operator 3: SimHash near-duplicates by exact tiled comparison.

Distinct fingerprints are sorted by population count and cut into tiles. A tile is compared with
every other whose population counts come within the radius, by exclusive-or and bit counts on numpy
arrays; inside a pair of tiles, runs of equal population counts of the four quarters are skipped in
the same way. What a pair of tiles gives is one link a fingerprint at most (to the least of its
component there), so that large groups don't become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared
from alpenglow.llm.vector import texts
from alpenglow.operators.components import components

SEED = 42
#: Fingerprints of a tile.
TILE = 16_384
#: Every byte's bits as eight bytes, so that up to 255 rows are summed eight counters at a time.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).reshape(256, 8).copy().view(np.uint64).ravel()


def hashed(raw: bytes, width: int = 3) -> bytes:
    """The XXH64 digests of a text's shingles, repeats included: of the whole sequence if it has fewer words, none without words."""
    words = raw.lower().split()
    if not words:
        return b""
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= width:
        return digest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = len(words) - width + 1
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(start[:n].tolist(), end[width - 1 :].tolist())])


def folded(hashes: bytes) -> int:
    """The 64-bit fingerprint of shingles hashed by :func:`hashed`; 0 if there are none."""
    n = len(hashes) // 8
    if not n:
        return 0
    rows = SPREAD[np.frombuffer(hashes, np.uint8)].reshape(n, 8)
    counts = np.add.reduceat(rows, np.arange(0, n, 255), axis=0).view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(raw: bytes, width: int = 3) -> int:
    """The 64-bit fingerprint of a text in UTF-8; 0 if it has no word."""
    return folded(hashed(raw, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp long)``; null texts count as empty (0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches):
            fp = np.array([fingerprint(x, width) for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _quarters(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def labels_of(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Least node of each node's component under the links (i, j), continuing from ``label``."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return label
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def tile_links(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node of its component) among two tiles' fingerprints (uint64); ``a is b`` compares a tile with itself."""
    same = a is b
    qa = _quarters(a)
    order_a = np.lexsort(qa.T)
    a, qa = a[order_a], qa[order_a]
    if same:
        b, qb = a, qa
    else:
        qb = _quarters(b)
        order_b = np.lexsort(qb.T)
        b, qb = b[order_b], qb[order_b]
    cut = lambda q: np.flatnonzero(np.r_[True, (q[1:] != q[:-1]).any(axis=1)])
    run_a, run_b = cut(qa), cut(qb)
    end_a, size_b = np.r_[run_a[1:], len(a)], np.diff(np.r_[run_b, len(b)])
    kind_b = qb[run_b]
    shift = 0 if same else len(a)
    both = a if same else np.concatenate((a, b))
    label = np.arange(len(both))
    for k, (s, e) in enumerate(zip(run_a.tolist(), end_a.tolist())):
        near = np.abs(kind_b - qa[s]).sum(axis=1) <= radius
        if same:
            near[:k] = False
        where = np.flatnonzero(np.repeat(near, size_b))
        if not len(where):
            continue
        for x in range(s, e, max(1, (1 << 22) // len(where))):
            y = min(e, x + max(1, (1 << 22) // len(where)))
            i, j = np.nonzero(np.bitwise_count(a[x:y, None] ^ b[None, where]) <= radius)
            label = labels_of(len(both), i + x, where[j] + shift, label)
    node = np.flatnonzero(label != np.arange(len(both)))
    return both[node], both[label[node]]


def links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links ``(u, v)`` that connect exactly the distinct fingerprints ``fp`` within ``radius`` bits of each other, over any number of steps."""
    n = fps.count()
    pop = F.bit_count("fp").cast("int")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(x: np.ndarray) -> pa.RecordBatch:
            p = np.bitwise_count(x.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (f"{x[0]:x}", int(p.min()), int(p.max()), x.tobytes())], schema=pa.schema([("tile", pa.string()), ("lo", pa.int32()), ("hi", pa.int32()), ("data", pa.binary())]))

        rest = np.zeros(0, np.int64)
        for batch in batches:
            rest = np.concatenate((rest, batch.column(0).to_numpy(zero_copy_only=False)))
            while len(rest) >= tile:
                yield row(rest[:tile])
                rest = rest[tile:]
        if len(rest):
            yield row(rest)

    dealt = fps.select("fp").repartitionByRange(max(1, -(-n // tile)), pop, "fp").sortWithinPartitions(pop, "fp")
    tiles = shared.written(dealt.mapInArrow(cut, "tile string, lo int, hi int, data binary"), "tiles")
    left = tiles.select("tile", "lo", "hi", F.explode(F.sequence(F.col("lo"), F.col("hi") + radius)).alias("p"))
    right = tiles.select(F.col("tile").alias("other"), F.col("lo").alias("lo2"), F.explode(F.sequence("lo", "hi")).alias("p"))
    after = (F.col("lo") < F.col("lo2")) | ((F.col("lo") == F.col("lo2")) & (F.col("tile") <= F.col("other")))
    pairs = left.join(right, "p").where(after).select("tile", "other").distinct()
    data = tiles.select("tile", "data")
    paired = pairs.join(data, "tile").join(data.select(F.col("tile").alias("other"), F.col("data").alias("data2")), "other")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_py(), np.uint64) for c in (2, 3))
                u, v = tile_links(x, x if batch.column(0)[k].as_py() == batch.column(1)[k].as_py() else y, radius)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    return paired.select("tile", "other", "data", "data2").mapInArrow(compare, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 3, width: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` of every row; component_id is the smallest doc_id that links reach.

    A text without words (also null) has fingerprint 0 and links like any other. Equal texts and
    repeated rows share a component. Rows with a null doc_id take part, and a component of such
    rows alone has a null id. An empty table gives an empty result; extra columns are not read.
    """
    rows = shared.written(fingerprints(docs, width), "fingerprints")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    distinct = shared.written(least, "distinct")
    found = components(links(distinct, radius))
    rooted = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
