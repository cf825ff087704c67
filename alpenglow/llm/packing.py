"""Operator 9: bounded-space online best-fit packing of token sequences.

Documents are tokenized once into pieces of at most ``size`` tokens. Packers, each with a large
share of all pieces, keep a fixed number of bins open; a bitset has a bit for every amount of free
space that some open bin has, so the best fit is its lowest set bit from the piece's length on. If
none fits and all bins are open, the fullest one (the lowest bit of all) closes first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared, words
from alpenglow.llm.vector import texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """At most ``most`` open bins of ``size``; :meth:`put` places one length and gives its bin and offset."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.bits = 0
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.size
            self.made += 1
        if left := free - length:
            self.by_free.setdefault(left, []).append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.size - free

    def _take(self, free: int) -> int:
        same = self.by_free[free]
        bin_ = same.pop()
        if not same:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return bin_


def pieces(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document's ids with ``end_id`` after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = words.codec(tokenizer)
        for batch, raw in texts(batches):
            ids, at = c.encode(raw)
            n = np.diff(at) + 1
            n_pieces = -(-n // size)
            doc = np.repeat(np.arange(len(n)), n_pieces)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
            start = piece * size
            length = np.minimum(size, n[doc] - start)
            crc = []
            for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist()):
                x = ids[at[d] + a : min(at[d] + a + k, at[d + 1])].astype("<u4")
                crc.append(zlib.crc32((np.append(x, np.uint32(end_id)).astype("<u4") if len(x) < k else x).tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, size: int = 4096, end_id: int = 1, open_bins: int = 1024, share: int = 250_000) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; sequences hold at most ``size`` tokens without gaps.

    A null text is empty: one piece that is the end id alone. Repeated rows are packed each on its
    own; null doc_ids stay; an empty table packs to nothing; extra columns are not read. Each
    packer has about ``share`` pieces, so the bins left open at its end are few beside its closed ones.
    """
    cut = shared.written(pieces(docs, tokenizer, size, end_id), "pieces")
    packers = max(1, -(-cut.count() // share))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(size, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            put = [bins.put(k) for k in batch.column("length").to_pylist()]
            seq = pa.array([base + b for b, _ in put], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, seq, pa.array([o for _, o in put], pa.int64())], names=[*batch.schema.names, "sequence_id", "offset"])

    # without a key the rows are dealt evenly whatever they hold; the order within a packer is fixed, so a rerun packs alike
    dealt = cut.repartition(packers).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "piece", "ids_crc32", "length")
    return dealt.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
