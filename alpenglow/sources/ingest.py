"""From raw tables to encoded nodes: parsing, filters, de-duplication, encoding.

The order of the steps is: fitness filter, parsing, de-duplication (first row kept), dropping of
invariant columns, encoding. Codes are levels' ranks, so an ordinal step of one is the next
observed level.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from alpenglow.errors import DataError, ParameterError
from alpenglow.functions.numbering import SMALL, numbered
from alpenglow.plans.cut import written

KINDS = ("boolean", "categorical", "ordinal")
#: Alphabets of the sequence kinds.
ALPHABETS = {"dna": "ACGT", "rna": "ACGU", "protein": "ACDEFGHIKLMNPQRSTVWY"}
#: Levels of a column up to which its codes are looked up in a literal array; beyond, a join finds them.
LITERAL_LEVELS = 2_000


@dataclass(frozen=True)
class Variable:
    name: str
    kind: str
    levels: int


@dataclass
class Encoded:
    """``nodes``: node_id, cfg array<int>, fitness, and the input's columns (also invariant ones)."""

    nodes: DataFrame
    variables: list[Variable]
    columns: list[str]
    kind: str = "default"
    alphabet: str | None = None
    n: int = 0


def read_csv(spark: SparkSession, path: str, fitness: str, columns: Sequence[str] | None = None, numeric: Sequence[str] = ()) -> DataFrame:
    """A CSV file whose columns stay strings (leading zeros count) but for the fitness and ``numeric``; rows with nulls there go."""
    raw = spark.read.option("header", True).csv(path)
    keep = list(columns) if columns else [c for c in raw.columns if c != fitness]
    cast = lambda c: F.col(f"`{c}`").cast("double") if c in numeric else F.col(f"`{c}`")
    return raw.select(*[cast(c).alias(c) for c in keep], F.col(f"`{fitness}`").cast("double").alias("fitness")).dropna(subset=[*keep, "fitness"])


def tau_filter(df: DataFrame, tau: float | None, maximize: bool, fitness: str = "fitness") -> DataFrame:
    """Rows at least as good as ``tau``."""
    if tau is None:
        return df
    return df.where(F.col(fitness) >= tau if maximize else F.col(fitness) <= tau)


def split_sequence(df: DataFrame, column: str, length: int, prefix: str, upper: bool = True) -> DataFrame:
    """One column for each position of a string column."""
    s = F.upper(F.col(column)) if upper else F.col(column)
    return df.select(*[F.substring(s, i + 1, 1).alias(f"{prefix}_{i}") for i in range(length)], *[c for c in df.columns if c != column])


def _lengths(df: DataFrame, column: str) -> int:
    low, high, null = df.agg(F.min(F.length(column)), F.max(F.length(column)), F.count_if(F.col(column).isNull())).first()
    if null or low is None or low != high or not low:
        raise DataError(f"sequences in {column} must be non-null and of one length; they have {low} to {high}")
    return int(low)


def parse_boolean(df: DataFrame, columns: Sequence[str] | None = None, fitness: str = "fitness") -> tuple[DataFrame, list[str], dict[str, str]]:
    """Bit strings in one column, or columns of booleans or 0 and 1, as integer columns."""
    columns = list(columns or [c for c in df.columns if c not in (fitness, "ordinal")])
    if len(columns) == 1 and dict(df.dtypes)[columns[0]] == "string":
        df = split_sequence(df, columns[0], _lengths(df, columns[0]), "bit")
        columns = [c for c in df.columns if c.startswith("bit_")]
    out = df.withColumns({c: F.when(F.lower(F.col(c).cast("string")).isin("1", "true", "1.0"), 1).when(F.lower(F.col(c).cast("string")).isin("0", "false", "0.0"), 0) for c in columns})
    if out.where(" or ".join(f"`{c}` is null" for c in columns)).limit(1).count():
        raise DataError("boolean variables hold 0 and 1 only")
    return out, columns, dict.fromkeys(columns, "boolean")


def parse_sequence(df: DataFrame, alphabet: str, columns: Sequence[str] | None = None, fitness: str = "fitness") -> tuple[DataFrame, list[str], dict[str, str]]:
    """Strings over an alphabet, or a letter a column, as upper-case letter columns; other letters are an error."""
    columns = list(columns or [c for c in df.columns if c not in (fitness, "ordinal")])
    if len(columns) == 1:
        df = split_sequence(df, columns[0], _lengths(df, columns[0]), "pos")
        columns = [c for c in df.columns if c.startswith("pos_")]
    out = df.withColumns({c: F.upper(F.col(c).cast("string")) for c in columns})
    wrong = " or ".join(f"`{c}` is null or length(`{c}`) <> 1 or instr('{alphabet}', `{c}`) = 0" for c in columns)
    if out.where(wrong).limit(1).count():
        raise DataError(f"sequences hold letters of {alphabet} only")
    return out, columns, dict.fromkeys(columns, "categorical")


def infer_alphabet(df: DataFrame, columns: Sequence[str] | str) -> str:
    """Sorted distinct symbols: characters of one string column, or cell values of several, a letter each.

    Nulls and empty cells have none; a table without any is an error. Lower-case symbols are symbols of
    their own here, but sequences are read in upper case, so :func:`parse_sequence` refuses an alphabet
    inferred from them: give upper-case data, or an ``alphabet``.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    if len(columns) == 1:
        cell = F.explode(F.array_distinct(F.split(F.col(f"`{columns[0]}`"), "")))
    else:
        cell = F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in columns]))
    # only single letters are collected, so what comes to the driver is an alphabet
    found, longest = df.select(cell.alias("s")).agg(F.array_sort(F.collect_set(F.when(F.length("s") == 1, F.col("s")))), F.max(F.length("s"))).first()
    if (longest or 0) > 1:
        raise DataError("symbols of sequences are single letters")
    if not found:
        raise DataError("no symbols to infer an alphabet from")
    return "".join(sorted(found))


def encode(df: DataFrame, kinds: dict[str, str], fitness: str = "fitness", ordinal: str | None = None, kind: str = "default", alphabet: str | None = None, levels: dict[str, list] | None = None) -> Encoded:
    """Encode ``df`` (columns of ``kinds`` and the fitness) into nodes.

    Null variables, or a fitness that is null or not finite, are an error. ``ordinal`` is a column
    whose order numbers the nodes and decides which duplicate is first; without it nodes are
    numbered in the order of their codes and, of duplicates, the one of least fitness stays.
    ``levels`` gives explicit orders of levels.
    """
    columns = list(kinds)
    for c, k in kinds.items():
        if k not in KINDS:
            raise ParameterError(f"{c}: {k!r} is none of {KINDS}")
        if c not in df.columns:
            raise DataError(f"no column {c}")
    quoted = [F.col(f"`{c}`") for c in columns]
    f = F.col(fitness).cast("double")
    base = df.withColumn("fitness", f) if fitness == "fitness" else df.withColumn("fitness", f).drop(fitness)
    base = base.select(*quoted, "fitness", *([F.col(ordinal).alias("ordinal")] if ordinal else []))
    bad = F.col("fitness").isNull() | F.isnan("fitness") | (F.abs("fitness") == float("inf"))
    first = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad).alias("bad"), *[F.count_if(c.isNull()).alias(f"null{i}") for i, c in enumerate(quoted)], *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(quoted)]).first()
    if not first["n"]:
        raise DataError("no rows are left")
    if first["bad"]:
        raise DataError("fitness must be finite")
    if nulls := [c for i, c in enumerate(columns) if first[f"null{i}"]]:
        raise DataError(f"missing values in {nulls}")
    # first of duplicates: a struct's least, combined before the shuffle
    least = F.min(F.struct(*(["ordinal"] if ordinal else []), "fitness")).alias("_first")
    unique = base.groupBy(*quoted).agg(least).select(*quoted, F.col("_first.fitness").alias("fitness"), *([F.col("_first.ordinal").alias("ordinal")] if ordinal else []))
    unique = written(unique, "unique")
    small = [i for i in range(len(columns)) if first[f"d{i}"] <= LITERAL_LEVELS]
    sets = unique.agg(*[F.array_sort(F.collect_set(quoted[i])).alias(f"s{i}") for i in small]).first() if small else None
    n_rows = unique.count()
    variables, codes, kept = [], [], []
    for i, c in enumerate(columns):
        if i in small:
            values = list(sets[f"s{i}"])
            given = (levels or {}).get(c)
            order = [v for v in given if v in set(values)] if given else values
            if alphabet and kinds[c] == "categorical":
                order = list(alphabet)
            if kinds[c] == "boolean":
                order = [0, 1]
            if len(values) <= 1:
                continue
            spark_type = dict(unique.dtypes)[c]
            array = F.array(*[F.lit(v) for v in order]).cast(f"array<{spark_type}>")
            codes.append((F.array_position(array, F.col(f"`{c}`")) - 1).cast("int"))
            n = 2 if kinds[c] == "boolean" else len(order)
        else:
            ranks = numbered(unique.select(F.col(f"`{c}`")).distinct(), [c], f"_code{i}", n_rows <= SMALL)
            unique = unique.join(ranks, c)
            codes.append(F.col(f"_code{i}").cast("int"))
            n = ranks.count()
        kept.append(c)
        variables.append(Variable(c, kinds[c], n))
    if not variables:
        raise DataError("every variable has one value only")
    coded = unique.withColumn("cfg", F.array(*codes))
    nodes = numbered(coded, ["ordinal"] if ordinal else ["cfg"], small=n_rows <= SMALL)
    nodes = nodes.select("node_id", "cfg", "fitness", *quoted)
    return Encoded(written(nodes, "nodes"), variables, columns, kind, alphabet, n_rows)


def missing_report(df: DataFrame) -> dict[str, int]:
    """Null counts of all columns, one aggregate."""
    row = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]).first()
    return {c: int(row[i]) for i, c in enumerate(df.columns)}


def first_of_duplicates(df: DataFrame, columns: Sequence[str], ordinal: str) -> DataFrame:
    """Rows of least ``ordinal`` for each combination of ``columns``."""
    w = Window.partitionBy(*columns).orderBy(ordinal)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")

