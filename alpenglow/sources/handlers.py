"""Input handlers of one's own: a kind of input that a user's code turns into variables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import DataError, ParameterError
from alpenglow.sources.ingest import KINDS

#: A table of the input's columns in, one of the same number of rows and the variables' columns out.
Parse = Callable[[pa.RecordBatch], pa.RecordBatch]


@dataclass(frozen=True)
class InputHandler:
    """``kinds`` of the variables that ``parse`` makes, and their Spark ``types`` (int where none is given).

    ``analyze``, if given, is asked once, with the input's column names and types, for the kinds and types instead.
    """

    parse: Parse
    kinds: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)
    analyze: Callable[[dict[str, str]], tuple[dict[str, str], dict[str, str]]] | None = None

    def apply(self, df: DataFrame, fitness: str, ordinal: str | None) -> tuple[DataFrame, dict[str, str]]:
        """``df`` with the handler's variables in place of its columns but the fitness (and the ordinal column), and their kinds.

        Rows with a null in an input column are passed on as they are; null variables are an error later on.
        An empty batch isn't parsed. A batch of another number of rows, or without a promised column, is an error.
        """
        given = [c for c in df.columns if c not in (fitness, ordinal)]
        kinds, types = self.analyze({c: t for c, t in df.dtypes if c in given}) if self.analyze else (self.kinds, self.types)
        if not kinds or (wrong := {k for k in kinds.values() if k not in KINDS}):
            raise ParameterError(f"a handler makes variables of the kinds {KINDS}, not {wrong if kinds else kinds}")
        if clash := {fitness, ordinal} & set(kinds):
            raise ParameterError(f"a handler can't make {sorted(clash)}")
        parse, names = self.parse, list(kinds)
        kept = [c for c in (fitness, ordinal) if c]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                made = parse(batch.select(given))
                if made.num_rows != batch.num_rows or (missing := set(names) - set(made.schema.names)):
                    raise DataError(f"a handler made {made.num_rows} rows of {batch.num_rows}" if made.num_rows != batch.num_rows else f"a handler made no {sorted(missing)}")
                yield pa.RecordBatch.from_arrays([*[made.column(n) for n in names], *[batch.column(c) for c in kept]], names=[*names, *kept])

        dtypes = dict(df.dtypes)
        schema = ", ".join([*[f"`{n}` {types.get(n, 'int')}" for n in names], *[f"`{c}` {dtypes[c]}" for c in kept]])
        return df.select(*[F.col(f"`{c}`") for c in [*given, *kept]]).mapInArrow(run, schema), dict(kinds)


class Handlers:
    """Handlers by kind; each registry has its own, so what one registers no other sees."""

    def __init__(self):
        self._by_kind: dict[str, InputHandler] = {}

    def register(self, kind: str, handler: InputHandler) -> None:
        if not isinstance(handler, InputHandler):
            raise ParameterError("a handler is an InputHandler")
        self._by_kind[kind] = handler

    def __contains__(self, kind: str) -> bool:
        return kind in self._by_kind

    def __getitem__(self, kind: str) -> InputHandler:
        return self._by_kind[kind]
