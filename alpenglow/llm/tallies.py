"""In how many texts a shingle comes, for shingles of several texts, told to every block of sets that holds them.

Blocks send the distinct shingles of their texts, four bytes each, to parts by hash; a part adds up
and answers with the frequent ones, which are stored beside the block. So nothing passes the driver
and nothing is broadcast, whatever the number of frequent shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import files
from alpenglow.llm.vector import ragged

#: Distinct shingles of blocks in a part, about.
PART = 2_000_000


def key(token: np.ndarray, parts: int) -> np.ndarray:
    """The part of a shingle and its upper 32 bits. Shingles of one key are counted together, which changes an order but no result."""
    return token % np.uint64(parts) << np.uint64(32) | token >> np.uint64(32)


def counts(token: np.ndarray, often: np.ndarray, parts: int) -> np.ndarray:
    """Texts that hold each shingle, by the table of its block; 0 for those of too few."""
    if not often.shape[1]:
        return np.zeros(len(token), np.int64)
    k = key(token, parts)
    at = np.minimum(np.searchsorted(often[0], k), often.shape[1] - 1)
    return np.where(often[0][at] == k, often[1][at], 0).astype(np.int64)


def tally(sets: DataFrame, folder: str, start: int, parts: int, least: int) -> int:
    """Stores ``{block}-often.npy`` (keys in order, counts) of shingles in ``least`` texts or more beside every block; gives the greatest count.

    ``sets`` are distinct texts (node, size), in order by partition, a block in one partition; a
    node is its block, ``start`` bits up, and the place of its set in the file of the block.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, size = (np.asarray(c) for c in batch.columns)
            for b in np.unique(node >> start).tolist():
                mine = node >> start == b
                flat = files.load(f"{folder}/{b}.npy")
                k, n = np.unique(key(np.asarray(flat[ragged(node[mine] & ((1 << start) - 1), size[mine])]), parts), return_counts=True)
                part = (k >> np.uint64(32)).astype(np.int64)
                cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)].tolist()
                data = [[v[x:y].tobytes() for x, y in zip(cut, cut[1:])] for v in (k.astype(np.uint32), n.astype(np.uint32))]
                at = part[cut[:-1]]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.full(len(at), b)), *(pa.array(v, pa.binary()) for v in data)], names=["part", "block", "low", "n"])
        files.forget()

    def add(dealt: pa.Table) -> pa.Table:
        """Every row is answered, if only by nothing, so that every block gets its file."""
        low, n = (np.frombuffer(b"".join(dealt.column(c).to_pylist()), np.uint32) for c in ("low", "n"))
        row = np.repeat(np.arange(dealt.num_rows), [len(x) // 4 for x in dealt.column("low").to_pylist()])
        _, of = np.unique(low, return_inverse=True)
        total = np.bincount(of, weights=n).astype(np.int64)[of]  # exact below 2^53
        many = total >= least
        full = low[many].astype(np.uint64) | np.uint64(dealt.column("part")[0].as_py()) << np.uint64(32)
        cut = np.searchsorted(row[many], np.arange(dealt.num_rows + 1)).tolist()
        data = [[v[x:y].tobytes() for x, y in zip(cut, cut[1:])] for v in (full, total[many])]
        return pa.table({"block": dealt.column("block"), "k": pa.array(data[0], pa.binary()), "n": pa.array(data[1], pa.binary())})

    def save(told: pa.Table) -> pa.Table:
        k = np.frombuffer(b"".join(told.column("k").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(told.column("n").to_pylist()), np.int64)
        k, one = np.unique(k, return_index=True)
        block = told.column("block")[0].as_py()
        files.save(f"{folder}/{block}-often.npy", np.stack((k, n[one].astype(np.uint64))))
        return pa.table({"block": pa.array([block], pa.int64()), "most": pa.array([int(n.max(initial=0))], pa.int64())})

    dealt = sets.mapInArrow(deal, "part long, block long, low binary, n binary")
    told = dealt.groupBy("part").applyInArrow(add, "block long, k binary, n binary")
    return told.groupBy("block").applyInArrow(save, "block long, most long").agg(F.coalesce(F.max("most"), F.lit(0))).first()[0]
