"""Row filters by rules, as column predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError

_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v,
    "in": lambda c, v: c.isin(list(v)), "not_in": lambda c, v: ~c.isin(list(v)),
}


@dataclass(frozen=True)
class Rule:
    """``op`` is a comparison, in, not_in, contains (a regular expression) or custom (a function of a pandas Series)."""

    column: str
    op: str
    value: Any = None

    def predicate(self, df: DataFrame) -> Column:
        c = F.col(f"`{self.column}`")
        if self.op in _COMPARE:
            out = _COMPARE[self.op](c, self.value)
            return F.coalesce(out, F.lit(self.op in ("!=", "not_in")))  # a null equals nothing
        if self.op == "contains":
            if dict(df.dtypes)[self.column] != "string":
                raise TypeError(f"contains needs text; {self.column} is {dict(df.dtypes)[self.column]}")
            return F.coalesce(c.rlike(self.value), F.lit(False))
        if self.op == "custom":
            check = self.value

            @F.pandas_udf("boolean")
            def judge(s: pd.Series) -> pd.Series:
                return s.map(check).astype(bool)

            return judge(c)
        raise ParameterError(f"unknown operation {self.op!r}")


@dataclass(frozen=True)
class RowFilter:
    """Rules joined by ``and`` or ``or``. A rule on a column that isn't there is skipped; with ``or`` and no rule left nothing passes."""

    rules: tuple[Rule, ...]
    combine: str = "and"

    def __post_init__(self):
        if self.combine not in ("and", "or"):
            raise ParameterError("rules are combined by 'and' or 'or'")

    def apply(self, df: DataFrame) -> DataFrame:
        usable = [r.predicate(df) for r in self.rules if r.column in df.columns]
        total = F.lit(self.combine == "and")
        for p in usable:
            total = (total & p) if self.combine == "and" else (total | p)
        return df.where(total)


def fitness_threshold(value: float, op: str = ">=", column: str = "fitness") -> RowFilter:
    return RowFilter((Rule(column, op, value),))


def config_values(values: dict[str, Any]) -> RowFilter:
    """Columns that equal a value, or are in a list of values."""
    return RowFilter(tuple(Rule(c, "in" if isinstance(v, (list, tuple, set)) else "==", v) for c, v in values.items()))


def custom_filter(column: str, check: Callable[[Any], bool]) -> RowFilter:
    return RowFilter((Rule(column, "custom", check),))


def combine_filters(filters: Iterable[RowFilter], combine: str = "and") -> RowFilter:
    return RowFilter(tuple(r for f in filters for r in f.rules), combine)
