"""Least squares: sums of products in Spark, a small solve on the driver; conjugate gradients for many terms."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError

#: Terms of a model up to which the products' matrix is solved on the driver (8 bytes a cell), and at most:
#: beyond the first, the driver and each task hold a few vectors of that length, never a matrix.
TERMS, MOST = 4_000, 4_000_000
#: Cells of a dense part of the design that a task holds at once.
CELLS = 2_000_000


@dataclass
class Fit:
    coefficients: np.ndarray
    intercept: float
    n: int
    sse: float
    sst: float

    @property
    def r2(self) -> float:
        return 1 - self.sse / self.sst if self.sst > 0 else (1.0 if self.sse < 1e-12 else 0.0)

    @property
    def rmse(self) -> float:
        return float(np.sqrt(self.sse / self.n))


@dataclass
class Sparse:
    """Cells of a part of a design that are not zero; such a part is not laid out where there are many terms."""

    rows: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    n: int
    terms: int

    def times(self, p: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * p[self.columns], self.n)

    def back(self, q: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * q[self.rows], self.terms)

    def dense(self) -> np.ndarray:
        out = np.zeros((self.n, self.terms))
        out[self.rows, self.columns] = self.values
        return out


def _laid_out(x: np.ndarray | Sparse) -> np.ndarray:
    return x.dense() if isinstance(x, Sparse) else x.astype(float)


def least_squares(nodes: DataFrame, design: Callable[[np.ndarray], np.ndarray], terms: int, intercept: bool = True, y: str = "fitness") -> Fit:
    """Least-norm fit of ``y`` on ``design(codes)``, a matrix of ``terms`` columns (or a :class:`Sparse`) for a batch of cfg.

    Each task sums its products; the sums of all tasks are added by an aggregation, cell by cell.
    With an intercept the products are centred before the solve. A second pass sums the squared
    residuals, which the products alone would give with less accuracy. More than TERMS terms are
    fitted by :func:`gradients`.
    """
    if terms > TERMS:
        return gradients(nodes, design, terms, intercept, y)

    def rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        lists = batch.column(0)
        codes = np.asarray(lists.flatten()).reshape(batch.num_rows, -1)
        return _laid_out(design(codes)), np.asarray(batch.column(1)).astype(float)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((terms + 2, terms + 2))
        for batch in batches:
            if batch.num_rows:
                x, target = rows(batch)
                z = np.column_stack((x, np.ones(len(x)), target))
                total += z.T @ z
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "s"])

    data = nodes.select("cfg", F.col(y).cast("double").alias("y"))
    cells = data.mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    m = np.zeros((terms + 2, terms + 2))
    m[np.asarray(cells.column("i")), np.asarray(cells.column("j"))] = np.asarray(cells.column("s"))
    n = int(round(m[terms, terms]))
    gram, moment, sums, ysum = m[:terms, :terms], m[:terms, terms + 1], m[:terms, terms], m[terms, terms + 1]
    if intercept:
        gram, moment = gram - np.outer(sums, sums) / n, moment - sums * ysum / n
    beta = np.linalg.pinv(gram, rcond=1e-11, hermitian=True) @ moment if terms else np.zeros(0)
    base = float((ysum - sums @ beta) / n) if intercept else 0.0
    mean = ysum / n

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sse = sst = 0.0
        for batch in batches:
            if batch.num_rows:
                x, target = rows(batch)
                sse += float(((target - base - x @ beta) ** 2).sum())
                sst += float(((target - mean) ** 2).sum())
        yield pa.RecordBatch.from_arrays([pa.array([sse]), pa.array([sst])], names=["sse", "sst"])

    sse, sst = data.mapInArrow(residuals, "sse double, sst double").agg(F.sum("sse"), F.sum("sst")).first()
    return Fit(beta, base, n, float(sse), float(sst))


def gradients(nodes: DataFrame, design: Callable[[np.ndarray], np.ndarray], terms: int, intercept: bool = True, y: str = "fitness", tolerance: float = 1e-10, rounds: int = 2_000) -> Fit:
    """The least-norm fit without a matrix: conjugate gradients on the normal equations.

    A round is one pass: each task multiplies its rows with the direction, and their products back onto
    the terms; the tasks' vectors are added term by term. It begins at zero, so it stays in the span of
    the rows, and ends when the gradient is ``tolerance`` of the first one (in norm), or after ``rounds``.
    With an intercept, rows and target are centred by their means.
    """
    if terms > MOST:
        raise ParameterError(f"{terms} terms are over the limit of {MOST}")
    data = nodes.select("cfg", F.col(y).cast("double").alias("y"))
    size = terms + 3  # one sum a term, and of the target, its square, and the rows

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        step = max(1, CELLS // max(1, terms))
        for batch in batches:
            if batch.num_rows:
                codes = np.asarray(batch.column(0).flatten()).reshape(batch.num_rows, -1)
                target = np.asarray(batch.column(1)).astype(float)
                for a in range(0, batch.num_rows, step):
                    yield design(codes[a : a + step]), target[a : a + step]

    # products with the rows less their means, which are never laid out for sparse rows
    times = lambda x, p: (x.times(p) if isinstance(x, Sparse) else x @ p) - mean_x @ p
    back = lambda x, q: (x.back(q) if isinstance(x, Sparse) else x.T @ q) - mean_x * q.sum()
    mean_x = np.zeros(terms)

    def summed(each: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for x, target in chunks(batches):
                total += each(x, target)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["t", "s"])

        cells = data.mapInArrow(run, "t long, s double").groupBy("t").agg(F.sum("s").alias("s")).toArrow()
        out = np.zeros(size)
        out[np.asarray(cells.column("t"))] = np.asarray(cells.column("s"))
        return out

    first = summed(lambda x, target: np.r_[back(x, np.ones(len(target))), target.sum(), 0.0, len(target)])
    n = int(first[-1])
    mean_x, mean_y = (first[:terms] / n, first[terms] / n) if intercept else (np.zeros(terms), 0.0)
    told = summed(lambda x, target: np.r_[back(x, target - mean_y), 0.0, ((target - first[terms] / n) ** 2).sum(), 0.0])
    gradient, sst = told[:terms], told[-2]
    beta, direction = np.zeros(terms), gradient.copy()
    norm = start = float(gradient @ gradient)
    for _ in range(rounds):
        if norm <= tolerance**2 * start or not start:
            break

        def onto(x: np.ndarray | Sparse, _: np.ndarray, direction: np.ndarray = direction) -> np.ndarray:
            q = times(x, direction)
            return np.r_[back(x, q), q @ q, 0.0, 0.0]

        product = summed(onto)
        if product[terms] <= 0:
            break
        step = norm / product[terms]
        beta = beta + step * direction
        gradient = gradient - step * product[:terms]
        norm, last = float(gradient @ gradient), norm
        direction = gradient + norm / last * direction
    base = mean_y - mean_x @ beta if intercept else 0.0
    sse = summed(lambda x, target: np.r_[np.zeros(terms), 0.0, ((target - mean_y - times(x, beta)) ** 2).sum(), 0.0])[-2]
    return Fit(beta, float(base), n, float(sse), float(sst))
