"""How many nodes reach each of many keys, and in how many steps, without a row for each pair.

Bit-parallel multi-source search: keys are numbered, 64 to a word. A round ORs the words of the nodes
that got new bits along their edges and keeps what the other end hasn't seen. New bits are counted by
word and bit, level by level, so a round moves at most edges x words rows, and the result has a row
for each key and level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.functions.numbering import numbered
from alpenglow.plans.cut import drop, exists, fresh, written

BITS = 64


STATE = "node {kind}, word int, new long, seen long, open boolean"


def _stored(state: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """A state as a table with the rows of new bits apart, which are counted at the end; the others go after the next round."""
    spark, path = state.sparkSession, fresh(state.sparkSession, "bits")
    state.withColumn("open", F.col("new") != 0).write.partitionBy("open").parquet(path)
    return spark.read.schema(STATE.format(kind=kind)).parquet(path), path


def reach_counts(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", among: DataFrame | None = None) -> DataFrame:
    """``(key, dist, n)``: how many nodes get from the seeds ``(key, node)`` of each key to themselves along ``src -> dst`` in ``dist`` steps at least.

    ``among`` ``(node)`` counts only these nodes. Keys without a counted node at some distance have no row there.
    Repeated seeds count once; no seeds give no rows; null keys or nodes take no part.
    """
    spark, kind = seeds.sparkSession, seeds.schema["node"].dataType.simpleString()
    seeds = written(seeds.select("key", "node").where("key is not null and node is not null").distinct(), "seeds")
    keys = written(numbered(seeds.select("key").distinct(), ["key"], "k"), "keys")
    step = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    word, bit = F.shiftright("k", 6).cast("int"), F.expr("shiftleft(1L, cast(k & 63 as int))")
    state, path = _stored(seeds.join(keys, "key").groupBy("node", word.alias("word")).agg(F.bit_or(bit).alias("new")).withColumn("seen", F.col("new")), kind)
    levels: list[DataFrame] = []
    while exists(spark, f"{path}/open=true"):
        new = state.where("open").select("node", "word", "new")
        levels.append(new.withColumn("dist", F.lit(len(levels))))
        sent = new.join(step, "node").groupBy(F.col("next").alias("node"), "word").agg(F.bit_or("new").alias("got"))
        none = F.lit(0).cast("long")
        both = state.select("node", "word", "seen", none.alias("got")).union(sent.select("node", "word", none, "got"))
        each = both.groupBy("node", "word").agg(F.bit_or("seen").alias("old"), F.bit_or("got").alias("got"))
        only = F.col("got").bitwiseAND(F.bitwise_not("old"))
        state, after = _stored(each.select("node", "word", only.alias("new"), F.col("old").bitwiseOR(F.col("got")).alias("seen")), kind)
        drop(spark, [f"{path}/open=false"])
        path = after
    rows = reduce(lambda a, b: a.union(b), levels) if levels else state.where("open").select("node", "word", "new", F.lit(0).alias("dist"))
    if among is not None:
        rows = rows.join(among.select("node").distinct(), "node", "left_semi")
    sums = [F.sum(F.shiftrightunsigned("new", b).bitwiseAND(F.lit(1))) for b in range(BITS)]
    flat = rows.groupBy("word", "dist").agg(F.array(*sums).alias("counts")).select("word", "dist", F.posexplode("counts").alias("bit", "n")).where("n > 0")
    return flat.withColumn("k", F.col("word").cast("long") * BITS + F.col("bit")).join(keys, "k").select("key", "dist", "n")


def sizes(counts: DataFrame) -> DataFrame:
    """``(key, size, mean, variance)`` of :func:`reach_counts`: nodes, and the mean and population variance of their steps."""
    d, n = F.col("dist"), F.col("n")
    sums = counts.groupBy("key").agg(F.sum("n").alias("size"), F.sum(d * n).alias("s"), F.sum(d * d * n).alias("q"))
    mean = F.col("s") / F.col("size")
    return sums.select("key", "size", mean.alias("mean"), (F.col("q") / F.col("size") - mean * mean).alias("variance"))
