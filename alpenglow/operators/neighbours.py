"""Neighbour construction: similarity self-joins as equi-joins on masked configurations.

Rows that differ at one position only agree on the rest, so each row is given once for every
position with that position masked, and rows with equal masks are joined. Where the product of the
variables' sizes fits into 63 bits the mask is one long; otherwise it is the masked array.

Rows are exploded before these joins, which Spark's estimates of size leave out: a table of a few MB
would be broadcast as gigabytes. So the joins are asked to be merges.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import ParameterError
from alpenglow.plans.cut import written
from alpenglow.sources.ingest import Variable

PAIRS = ["p", "u", "v", "a", "b", "fu", "fv"]
#: Masks of a row up to which they are joined as they are; rows of a segment beyond which it is cut once more.
MASKS, HOT = 64, 2_000


def radixes(variables: list[Variable]) -> list[int] | None:
    """Place values of a mixed-radix code with a digit to spare at each position; None beyond 63 bits."""
    out, at = [], 1
    for v in variables:
        out.append(at)
        at *= v.levels + 1
    return out if at < 1 << 62 else None


def masked_key(variables: list[Variable], masked: Column | tuple[int, ...], cfg: str = "cfg") -> Column:
    """Key of a configuration without the positions ``masked`` (a column: one position)."""
    place = radixes(variables)
    hidden = (lambda i: masked == i) if isinstance(masked, Column) else (lambda i: F.lit(i in masked))
    if place is None:
        return F.transform(cfg, lambda x, i: F.when(F.array_contains(F.array(*[F.lit(m) for m in masked]), i) if isinstance(masked, tuple) else masked == i, -1).otherwise(x))
    terms = [F.when(hidden(i), F.lit(0)).otherwise(F.element_at(cfg, i + 1) + 1).cast("long") * F.lit(w).cast("long") for i, w in enumerate(place)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def positions(nodes: DataFrame, variables: list[Variable]) -> DataFrame:
    """``(node_id, fitness, p, a, key)``: every node once for each position p, with its code there and the key of the rest."""
    rows = nodes.select("node_id", "fitness", "cfg", F.posexplode("cfg").alias("p", "a"))
    return rows.select("node_id", "fitness", "p", "a", masked_key(variables, F.col("p")).alias("key"))


def hamming_pairs(nodes: DataFrame, variables: list[Variable], typed: bool = False) -> DataFrame:
    """``(p, u, v, a, b, fu, fv)`` of all nodes that differ at position p only, codes a < b.

    ``typed``: at ordinal positions only codes one step apart. Those are found by joining a code
    with its successor, so that a long scale gives no pairs that are then thrown away.
    """
    rows = positions(nodes, variables)
    steps = [i for i, v in enumerate(variables) if v.kind == "ordinal"] if typed else []
    is_step = F.col("p").isin(steps) if steps else F.lit(False)
    left = rows.select("p", "key", F.when(is_step, F.col("a") + 1).otherwise(0).alias("slot"), F.col("node_id").alias("u"), "a", F.col("fitness").alias("fu"))
    right = rows.select("p", "key", F.when(is_step, F.col("a")).otherwise(0).alias("slot"), F.col("node_id").alias("v"), F.col("a").alias("b"), F.col("fitness").alias("fv"))
    return left.join(right.hint("merge"), ["p", "key", "slot"]).where("a < b").select(*PAIRS)


def edit_pairs(nodes: DataFrame, variables: list[Variable], n_edit: int) -> DataFrame:
    """``(u, v, fu, fv)``, u < v, of all nodes that differ at 1 to ``n_edit`` positions.

    Few masks are joined as they are; where choosing ``n_edit`` positions gives more than MASKS keys a
    row, pairs are found by equal segments instead.
    """
    if n_edit < 1:
        raise ParameterError("n_edit must be 1 or more")
    n_edit = min(n_edit, len(variables))
    if math.comb(len(variables), n_edit) > MASKS:
        return segment_pairs(nodes, len(variables), n_edit, levels=max(v.levels for v in variables))
    masks = list(combinations(range(len(variables)), n_edit))
    keys = F.array(*[F.struct(F.lit(m).alias("m"), masked_key(variables, c).alias("key")) for m, c in enumerate(masks)])
    rows = nodes.select("node_id", "fitness", F.explode(keys).alias("k")).select("node_id", "fitness", "k.m", "k.key")
    left = rows.select("m", "key", F.col("node_id").alias("u"), F.col("fitness").alias("fu"))
    right = rows.select("m", "key", F.col("node_id").alias("v"), F.col("fitness").alias("fv"))
    return left.join(right.hint("merge"), ["m", "key"]).where("u < v").select("u", "v", "fu", "fv").distinct()


def bit_planes(n: int, levels: int, cfg: str = "cfg") -> list[list[Column]]:
    """Codes below ``levels`` as longs: for each 64 of the n positions, one long for each bit of a code, a bit a position."""
    bit = lambda w, j: F.aggregate(F.reverse(F.slice(cfg, w + 1, 64)), F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.shiftright(x, j).bitwiseAND(F.lit(1)).cast("long")))
    return [[bit(w, j) for j in range(max(1, (levels - 1).bit_length()))] for w in range(0, n, 64)]


def _mask(places: list[int], n: int) -> list[int]:
    """Bits of these places, for each 64 of n positions one signed long."""
    words = [sum(1 << (i - w) for i in places if w <= i < w + 64) for w in range(0, n, 64)]
    return [x - (1 << 64) if x >> 63 else x for x in words]


def _segments(places: list[int], parts: int) -> list[list[int]]:
    """Places cut into ``parts`` segments of even lengths, of which some may be empty."""
    cuts = [len(places) * i // parts for i in range(parts + 1)]
    return [places[a:b] for a, b in zip(cuts, cuts[1:])]


def segment_pairs(nodes: DataFrame, n: int, n_edit: int, hot: int = HOT, levels: int | None = None) -> DataFrame:
    """The pairs of :func:`edit_pairs` by pigeonhole: of ``n_edit`` + 1 segments of the n positions, one at least is equal.

    Rows with an equal segment are candidates, verified at all positions; a pair is given by its
    first equal segment only, so none comes twice and nothing is made distinct. Rows of a
    segment that more than ``hot`` share are cut once more: the rest of their positions differs at
    ``n_edit`` places at most too, so of its ``n_edit`` + 1 segments one is equal as well. Rows travel as
    bit planes of their codes (all below ``levels``; not given: looked up), which candidates are told apart by.
    """
    parts = n_edit + 1
    if levels is None:
        levels = (nodes.agg(F.max(F.array_max("cfg"))).first()[0] or 0) + 1
    made = bit_planes(n, levels)
    names = [[f"c{w}_{j}" for j in range(len(word))] for w, word in enumerate(made)]
    codes, keys = [c for word in names for c in word], [f"k{c}" for word in names for c in word]
    first = _segments(list(range(n)), parts)
    second = [_segments([i for i in range(n) if i not in set(x)], parts) for x in first]
    one, two = [_mask(x, n) for x in first], [[_mask(y, n) for y in x] for x in second]
    long = lambda x: F.lit(x).cast("long")
    of_s = lambda values: F.element_at(F.array(*[long(x) for x in values]), F.col("s") + 1)
    under = lambda masks: [F.col(c).bitwiseAND(masks[w]).alias(f"k{c}") for w, word in enumerate(names) for c in word]

    rows = nodes.select("node_id", "fitness", *[x.alias(c) for word, cs in zip(made, names) for x, c in zip(word, cs)])
    keyed = rows.select("*", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), *under([long(x) for x in m])) for s, m in enumerate(one)])).alias("x")).select(*rows.columns, "x.*")
    frequent = written(keyed.groupBy("s", *keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("s", *keys), "hot-segments")
    told = keyed.join(frequent.withColumn("many", F.lit(True)), ["s", *keys], "left")
    whole = F.array(F.struct(F.lit(-1).alias("s2"), *keys))
    finer = F.array(*[F.struct(F.lit(t).alias("s2"), *under([of_s([one[s][w] | two[s][t][w] for s in range(parts)]) for w in range(len(names))])) for t in range(parts)])
    cand = told.select("s", *rows.columns, F.explode(F.when(F.col("many"), finer).otherwise(whole)).alias("x")).select("s", *rows.columns, "x.*")
    left = cand.select("s", "s2", *keys, F.col("node_id").alias("u"), F.col("fitness").alias("fu"), *[F.col(c).alias(f"u{c}") for c in codes])
    right = cand.select("s", "s2", *keys, F.col("node_id").alias("v"), F.col("fitness").alias("fv"), *[F.col(c).alias(f"v{c}") for c in codes])
    met = left.join(right.hint("merge"), ["s", "s2", *keys]).where("u < v")  # Spark takes exploded rows for few, and would broadcast them
    apart = [reduce(Column.bitwiseOR, [F.col(f"u{c}").bitwiseXOR(F.col(f"v{c}")) for c in word]) for word in names]
    differs = lambda masks: reduce(Column.bitwiseOR, [d.bitwiseAND(m) for d, m in zip(apart, masks)]) != 0
    own = [(F.col("s") <= t) | differs([long(x) for x in one[t]]) for t in range(parts)]
    again = [(F.col("s2") <= t) | differs([of_s([two[s][t][w] for s in range(parts)]) for w in range(len(names))]) for t in range(parts)]
    near = reduce(Column.__add__, [F.bit_count(d) for d in apart]) <= n_edit
    return met.where(reduce(Column.__and__, [near, *own, *again])).select("u", "v", "fu", "fv")


def generated_pairs(nodes: DataFrame, generate: Callable) -> DataFrame:
    """``(u, v, fu, fv)`` of nodes one of which ``generate`` names as the other's neighbour (a user's own rule).

    It is given one tuple of codes and returns a list of them, or, if its attribute ``batches`` is true, a
    matrix of codes, and returns the rows that have neighbours and these neighbours' codes.
    """
    whole = bool(getattr(generate, "batches", False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            if whole:
                own, near = (np.asarray(x) for x in generate(codes))
            else:
                each = [[tuple(n) for n in generate(tuple(c))] for c in codes.tolist()]
                own = np.repeat(np.arange(len(each)), [len(e) for e in each])
                near = np.array([n for e in each for n in e], np.int64)
            near = near.reshape(len(own), codes.shape[1]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * codes.shape[1]), pa.array(near.ravel()))
            take = pa.array(own, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), lists], names=["u", "fu", "cfg"])

    made = nodes.select("node_id", "cfg", F.col("fitness").cast("double").alias("fitness")).mapInArrow(run, "u long, fu double, cfg array<int>")
    other = nodes.select("cfg", F.col("node_id").alias("v"), F.col("fitness").alias("fv"))
    met = made.join(other, "cfg").where("u <> v")
    swap = F.col("u") > F.col("v")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    return met.select(pick("u", "v").alias("u"), pick("v", "u").alias("v"), pick("fu", "fv").alias("fu"), pick("fv", "fu").alias("fv")).distinct()


def neutral_bound(epsilon: float) -> float:
    """Differences up to this are neutral: just above epsilon, so that a difference of epsilon counts."""
    return 0.0 if epsilon <= 0 else math.nextafter(epsilon, math.inf)


def classify(pairs: DataFrame, epsilon: float, maximize: bool) -> tuple[DataFrame, DataFrame]:
    """Improving edges ``(src, dst, delta_fit)``, worse to better, and neutral pairs ``(u, v)``."""
    delta = F.abs(F.col("fu") - F.col("fv"))
    neutral = delta <= F.lit(neutral_bound(epsilon))
    up = (F.col("fu") < F.col("fv")) if maximize else (F.col("fu") > F.col("fv"))
    edges = pairs.where(~neutral).select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("src"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("dst"), delta.alias("delta_fit"))
    return edges, pairs.where(neutral).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))

