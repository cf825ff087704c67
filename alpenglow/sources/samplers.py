"""Samples of configurations and their fitness: random, grid, Latin hypercube, Sobol.

The driver lays out the configurations; a user's ``evaluate`` runs on the executors.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from alpenglow.errors import ParameterError

Evaluate = Callable[[dict[str, Any]], float]

#: Degree, coefficients and first direction numbers of Sobol dimensions from the second on.
SOBOL = (
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)),
    (5, 2, (1, 1, 5, 5, 17)), (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)),
)
BITS = 30


def evaluated(spark: SparkSession, configs: list[dict[str, Any]], evaluate: Evaluate) -> DataFrame:
    """The configurations with ``fitness``, evaluated in parallel."""
    frame = pd.DataFrame(configs)
    rows = spark.createDataFrame(frame.reset_index(names="ordinal"))
    names = list(frame.columns)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(fitness=[float(evaluate(dict(zip(names, r)))) for r in f[names].itertuples(index=False, name=None)])

    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in rows.schema.fields)
    spread = rows.repartition(min(len(configs), spark.sparkContext.defaultParallelism) or 1)
    return spread.mapInPandas(run, f"{fields}, fitness double")


def _listed(params: dict[str, Any], method: str) -> tuple[dict[str, Any], dict[str, list]]:
    made = {k: v for k, v in params.items() if hasattr(v, method)}
    lists = {k: v for k, v in params.items() if k not in made}
    if wrong := [k for k, v in lists.items() if not isinstance(v, list)]:
        raise ParameterError(f"{wrong} are neither lists nor have {method}()")
    return made, lists


def random_search(spark: SparkSession, params: dict[str, Any], n: int, evaluate: Evaluate, seed: int | None = None) -> DataFrame:
    """``n`` draws, from lists or from objects with ``rvs()``."""
    _listed(params, "rvs")
    rng = np.random.default_rng(seed)
    draw = lambda v: v[int(rng.integers(len(v)))] if isinstance(v, list) else v.rvs()
    return evaluated(spark, [{k: draw(v) for k, v in params.items()} for _ in range(n)], evaluate)


def grid_search(spark: SparkSession, grid: dict[str, list], evaluate: Evaluate) -> DataFrame:
    """Every combination of the lists."""
    if wrong := [k for k, v in grid.items() if not isinstance(v, list)]:
        raise ParameterError(f"{wrong} must be lists")
    return evaluated(spark, [dict(zip(grid, c)) for c in itertools.product(*grid.values())], evaluate)


def latin_hypercube(n: int, dims: int, rng: np.random.Generator) -> np.ndarray:
    """Points of which each of n equal slices of every axis has one."""
    return np.column_stack([(rng.permutation(n) + rng.random(n)) / n for _ in range(dims)]) if dims else np.zeros((n, 0))


def sobol(n: int, dims: int, scramble: bool, rng: np.random.Generator) -> np.ndarray:
    """The first n Sobol points by Gray code, shifted digitally if scrambled."""
    if dims > len(SOBOL) + 1:
        raise ParameterError(f"at most {len(SOBOL) + 1} dimensions")
    out = np.zeros((n, dims))
    for d in range(dims):
        if d == 0:
            v = [1 << (BITS - 1 - k) for k in range(BITS)]
        else:
            s, a, m = SOBOL[d - 1]
            v = [x << (BITS - 1 - k) for k, x in enumerate(m)]
            for k in range(s, BITS):
                x = v[k - s] ^ (v[k - s] >> s)
                for j in range(1, s):
                    if a >> (s - 1 - j) & 1:
                        x ^= v[k - j]
                v.append(x)
        shift, x = int(rng.integers(1 << BITS)) if scramble else 0, 0
        for i in range(n):
            out[i, d] = (x ^ shift) / (1 << BITS)
            x ^= v[(~i & (i + 1)).bit_length() - 1]
    return out


def _by_quantiles(spark, params, n, evaluate, seed, points) -> DataFrame:
    made, lists = _listed(params, "ppf")
    rng = np.random.default_rng(seed)
    unit = points(n, len(made), rng)
    columns = {k: v.ppf(unit[:, i]) for i, (k, v) in enumerate(made.items())}
    columns |= {k: [v[int(rng.integers(len(v)))] for _ in range(n)] for k, v in lists.items()}
    return evaluated(spark, [{k: columns[k][i] for k in params} for i in range(n)], evaluate)


def latin_hypercube_sampling(spark: SparkSession, params: dict[str, Any], n: int, evaluate: Evaluate, seed: int | None = None) -> DataFrame:
    """Latin hypercube over objects with ``ppf()``; lists are drawn from."""
    return _by_quantiles(spark, params, n, evaluate, seed, latin_hypercube)


def sobol_sampling(spark: SparkSession, params: dict[str, Any], n: int, evaluate: Evaluate, scramble: bool = True, seed: int | None = None) -> DataFrame:
    """Sobol points over objects with ``ppf()``; lists are drawn from."""
    return _by_quantiles(spark, params, n, evaluate, seed, lambda n, d, rng: sobol(n, d, scramble, rng))
