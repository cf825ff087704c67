"""All metrics of a landscape at once."""

from __future__ import annotations

import inspect
import logging
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from alpenglow.errors import ParameterError
from alpenglow.plans import metrics as M
from alpenglow.plans.landscape import Landscape

log = logging.getLogger("alpenglow")


@dataclass(frozen=True)
class Metric:
    """A function of a landscape; ``columns`` maps result columns to profile columns."""

    name: str
    group: str
    function: Callable[..., DataFrame]
    columns: dict[str, str] = field(default_factory=lambda: {})

    @property
    def names(self) -> list[str]:
        return list(self.columns.values()) or [self.name]


def _fields(prefix: str, *names: str, **renamed: str) -> dict[str, str]:
    return {n: f"{prefix}.{n}" for n in names} | {k: f"{prefix}.{v}" for k, v in renamed.items()}


METRICS: tuple[Metric, ...] = (
    Metric("fitness_distribution", "fitness", M.fitness_distribution, _fields("fitness", "skewness", "kurtosis", "cv", "quartile_coefficient", "median_mean_ratio", "relative_range", "cauchy_loc")),
    Metric("local_optima_ratio", "ruggedness", M.local_optima_ratio),
    Metric("gradient_intensity", "ruggedness", M.gradient_intensity),
    Metric("autocorrelation", "ruggedness", M.autocorrelation),
    Metric("r_s_ratio", "ruggedness", M.r_s_ratio),
    Metric("neutrality", "robustness", M.neutrality),
    Metric("evolvability_enhancing_mutations", "robustness", M.evolvability_enhancing_mutations),
    Metric("fdc", "correlation", M.fdc),
    Metric("basin_fitness_correlation", "correlation", M.basin_fitness_correlation),
    Metric("neighbor_fitness_correlation", "correlation", M.neighbor_fitness_correlation),
    Metric("fitness_flattening_index", "correlation", M.fitness_flattening_index),
    Metric("global_optima_accessibility", "navigability", M.global_optima_accessibility),
    Metric("mean_path_length_to_global_optimum", "navigability", M.mean_path_length_to_global_optimum),
    Metric("mean_distance_to_global_optimum", "navigability", M.mean_distance_to_global_optimum),
    Metric("gamma", "epistasis", M.gamma),
    Metric("gamma_star", "epistasis", M.gamma_star),
    Metric("higher_order_epistasis", "epistasis", M.higher_order_epistasis),
    Metric("global_idiosyncratic_index", "epistasis", M.global_idiosyncratic_index),
    Metric("diminishing_returns_index", "epistasis", M.diminishing_returns_index),
    Metric("increasing_costs_index", "epistasis", M.increasing_costs_index),
    Metric("classify_epistasis", "epistasis", M.classify_epistasis, _fields("epistasis", "magnitude", "sign", "reciprocal_sign", "positive", "negative")),
    Metric("extradimensional_bypass", "epistasis", M.extradimensional_bypass, _fields("bypass", bypass_proportion="proportion", average_bypass_length="avg_length")),
)
BY_NAME = {m.name: m for m in METRICS}
GROUPS = tuple(dict.fromkeys(m.group for m in METRICS))


def select(groups: Iterable[str] | None = None, include: Iterable[str] | None = None, exclude: Iterable[str] | None = None) -> list[Metric]:
    """Metrics of some groups or of some names (not both), without the excluded ones."""
    if groups is not None and include is not None:
        raise ParameterError("give groups or include, not both")
    one = lambda x: [x] if isinstance(x, str) else list(x)
    for names, known in ((groups, GROUPS), (include, BY_NAME), (exclude, BY_NAME)):
        if names is not None and (wrong := [n for n in one(names) if n not in known]):
            raise ParameterError(f"unknown: {wrong}")
    chosen = [m for m in METRICS if (groups is None or m.group in one(groups)) and (include is None or m.name in one(include))]
    return [m for m in chosen if exclude is None or m.name not in one(exclude)]


def profile(
    land: Landscape | list[Landscape], groups=None, include=None, exclude=None, params: dict[str, dict[str, Any]] | None = None, on_error: str = "warn", structure: bool = False, workers: int = 4,
    **shared: Any,
) -> DataFrame:
    """One row a landscape, a double for every metric's column; ``workers`` metrics are worked on at a time.

    ``shared`` arguments go to the metrics that take them, ``params`` to single ones. A metric that
    fails gives nulls, with a warning or (on_error ``ignore``) without, or raises (``raise``).
    """
    if on_error not in ("warn", "raise", "ignore"):
        raise ParameterError("on_error is 'warn', 'raise' or 'ignore'")
    if isinstance(land, list):
        if not land:
            raise ParameterError("no landscapes")
        out = None
        for x in land:
            row = profile(x, groups, include, exclude, params, on_error, structure, workers, **shared)
            out = row if out is None else out.unionByName(row)
        return out
    row: dict[str, float | None] = {}
    if structure:
        row |= {f"structure.{k}": float(v) for k, v in {"n_configs": land.n_configs, "n_edges": land.n_edges, "n_vars": land.n_vars, "n_lo": land.n_lo}.items()}
    def measured(m: Metric) -> dict[str, float | None]:
        taken = {k: v for k, v in shared.items() if k in inspect.signature(m.function).parameters} | (params or {}).get(m.name, {})
        try:
            got = m.function(land, **taken).first().asDict()
        except Exception as e:
            if on_error == "raise":
                raise
            if on_error == "warn":
                log.warning("%s failed: %s", m.name, e)
            got = {}
        columns = m.columns or {next(iter(got), "value"): m.name}
        return {to: None if got.get(c) is None else float(got[c]) for c, to in columns.items()}

    # the metrics' jobs are short and wait for each other's stages, so several run at once; what they share is made once
    with ThreadPoolExecutor(workers) as pool:
        for found in pool.map(measured, select(groups, include, exclude)):
            row |= found
    return land.spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` double" for c in row))


def list_metrics(spark: SparkSession) -> DataFrame:
    """``(name, group, columns)`` of all metrics."""
    return spark.createDataFrame([(m.name, m.group, m.names) for m in METRICS], "name string, `group` string, columns array<string>")
