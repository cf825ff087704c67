"""Reading vector columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", zero: bool = True, also: tuple[str, ...] = ()) -> DataFrame:
    """``(vec_id long, vec array<double>)`` of the rows that take part: no null id, vector or component, all components finite.

    ``zero=False`` also leaves out vectors whose components are all zero (and empty ones). Columns of
    ``also`` come along.
    """
    x = F.col(vec_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("vec"), *also).where("vec_id is not null and vec is not null")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    rows = rows.where(F.forall("vec", finite))
    return rows if zero else rows.where(F.exists("vec", lambda v: v != 0))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of a list column; shorter ones are filled with zeros."""
    size = np.asarray(column.value_lengths()).astype(np.int64)
    flat = np.asarray(column.flatten())
    width = max(int(size.max(initial=0)), width or 0)
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype if len(flat) else np.float64)
    out[np.arange(width) < size[:, None]] = flat
    return out


def topped(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows (query, id, score), the k of least (score, id) for each query."""
    order = np.lexsort((ids, score, query))
    query, ids, score = query[order], ids[order], score[order]
    head = np.r_[True, query[1:] != query[:-1]][: len(query)]
    start = np.flatnonzero(head)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.r_[start, len(query)]))
    keep = rank < k
    return query[keep], ids[keep], score[keep]
