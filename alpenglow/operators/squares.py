"""Two-locus squares: configurations that differ at two positions only, four at a time.

A square is a Hamming pair at position p (codes a < b) met with another pair at p with the same
codes, whose background differs at one further position q. The join runs on the background without
p and q, so no two pairs meet that don't make a square.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.operators.neighbours import masked_key, neutral_bound, positions, radixes
from alpenglow.sources.ingest import Variable


def squares(nodes: DataFrame, pairs: DataFrame, variables: list[Variable], typed: bool = False) -> DataFrame:
    """``(p, q, a, b, c, d, n00, n10, n01, n11, f00, f10, f01, f11)``, p < q: codes a < b at p, c < d at q.

    n10 has b at p, n01 has d at q. ``pairs`` are all Hamming pairs, or the typed ones (with
    ``typed``, the second position is held to its steps as well).
    """
    n = len(variables)
    cfg = nodes.select(F.col("node_id").alias("u"), "cfg")
    rows = pairs.where(F.col("p") < n - 1).join(cfg, "u")
    rows = rows.withColumn("q", F.explode(F.sequence(F.col("p") + 1, F.lit(n - 1))))
    first = masked_key(variables, F.col("p"))
    # the key without p and q: the key without p, less q's digit
    place = radixes(variables)
    c = F.element_at("cfg", F.col("q") + 1)
    if place is not None:
        weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in place]), F.col("q") + 1)
        key = first - (c + 1).cast("long") * weight
    else:
        key = F.transform("cfg", lambda x, i: F.when((i == F.col("p")) | (i == F.col("q")), -1).otherwise(x))
    rows = rows.select("p", "q", "a", "b", key.alias("key"), c.alias("c"), "u", "v", "fu", "fv")
    steps = [i for i, v in enumerate(variables) if v.kind == "ordinal"] if typed else []
    is_step = F.col("q").isin(steps) if steps else F.lit(False)
    left = rows.withColumn("slot", F.when(is_step, F.col("c") + 1).otherwise(0))
    right = rows.select("p", "q", "a", "b", "key", F.when(is_step, F.col("c")).otherwise(0).alias("slot"), F.col("c").alias("d"), F.col("u").alias("u2"), F.col("v").alias("v2"), F.col("fu").alias("fu2"), F.col("fv").alias("fv2"))
    met = left.join(right, ["p", "q", "a", "b", "key", "slot"]).where("c < d")
    return met.select("p", "q", "a", "b", "c", "d", F.col("u").alias("n00"), F.col("v").alias("n10"), F.col("u2").alias("n01"), F.col("v2").alias("n11"), F.col("fu").alias("f00"), F.col("fv").alias("f10"), F.col("fu2").alias("f01"), F.col("fv2").alias("f11"))


def line_cycles(nodes: DataFrame, variables: list[Variable], epsilon: float) -> DataFrame:
    """One row ``(n)``: cycles of four improving edges among configurations that differ at one position only.

    Such a cycle has two sources and two sinks; both pairs are neutral. It needs four levels of a
    categorical position. Without epsilon, pairs of equal fitness are counted by value.
    """
    wide = [i for i, v in enumerate(variables) if v.kind == "categorical" and v.levels >= 4]
    rows = positions(nodes, variables).where(F.col("p").isin(wide) if wide else F.lit(False))
    if epsilon <= 0:
        same = rows.groupBy("p", "key", "fitness").agg(F.count(F.lit(1)).alias("k")).withColumn("c", (F.col("k") * (F.col("k") - 1) / 2).cast("double"))
        lines = same.groupBy("p", "key").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
        return lines.agg(F.coalesce(F.sum((F.col("s") * F.col("s") - F.col("q")) / 2), F.lit(0.0)).cast("long").alias("n"))
    bound = F.lit(neutral_bound(epsilon))
    end = lambda x: rows.select("p", "key", F.col("node_id").alias(f"n{x}"), F.col("fitness").alias(f"f{x}"))
    near = end(1).join(end(2), ["p", "key"]).where((F.col("n1") < F.col("n2")) & (F.abs(F.col("f1") - F.col("f2")) <= bound))
    other = near.toDF("p", "key", "n3", "f3", "n4", "f4")
    apart = F.lit(True)
    for a in ("f1", "f2"):
        for b in ("f3", "f4"):
            apart = apart & (F.abs(F.col(a) - F.col(b)) > bound)
    return near.join(other, ["p", "key"]).where((F.col("n1") < F.col("n3")) & apart).agg(F.count(F.lit(1)).alias("n"))


def gamma_sums(found: DataFrame) -> DataFrame:
    """One row ``(gamma, gamma_star)``: correlation of a mutation's effects over backgrounds one step apart, of the effects and of their signs.

    Every square counts for both of its positions: as the change of p's effect with q, and of q's with p.
    """
    b1, b2 = F.col("f10") - F.col("f00"), F.col("f11") - F.col("f01")
    c1, c2 = F.col("f01") - F.col("f00"), F.col("f11") - F.col("f10")
    s = F.signum
    both = found.agg(
        F.sum(b1 * b2 + c1 * c2).alias("top"), F.sum((b1 * b1 + b2 * b2 + c1 * c1 + c2 * c2) / 2).alias("bottom"),
        F.sum(s(b1) * s(b2) + s(c1) * s(c2)).alias("top_sign"), F.sum((s(b1) * s(b1) + s(b2) * s(b2) + s(c1) * s(c1) + s(c2) * s(c2)) / 2).alias("bottom_sign"),
    )
    return both.select(F.try_divide("top", "bottom").alias("gamma"), F.try_divide("top_sign", "bottom_sign").alias("gamma_star"))


def classified(found: DataFrame, bound: float, maximize: bool) -> DataFrame:
    """Squares of four improving edges with their ``kind`` (magnitude, sign, reciprocal), and ``positive``.

    A square with a neutral side is none. The double mutant is the node of greatest fitness (least
    id of equals, whatever the direction of search); with its two single mutants it is positive if
    it gains more over the fourth node than they do together.
    """
    sides = {"e1": ("f00", "f10"), "e2": ("f01", "f11"), "e3": ("f00", "f01"), "e4": ("f10", "f11")}
    rows = found.withColumns({e: F.col(y) - F.col(x) for e, (x, y) in sides.items()})
    for e in sides:
        rows = rows.where(F.abs(e) > F.lit(bound))
    up = (lambda e: F.col(e) > 0) if maximize else (lambda e: F.col(e) < 0)
    # in-edges of each corner: a source has none, a sink two
    inn = {"00": (~up("e1"), ~up("e3")), "10": (up("e1"), ~up("e4")), "01": (~up("e2"), up("e3")), "11": (up("e2"), up("e4"))}
    count = lambda k, n: sum((F.when(a.cast("int") + b.cast("int") == n, 1).otherwise(0) for a, b in [inn[k]]), F.lit(0))
    sources = count("00", 0) + count("10", 0) + count("01", 0) + count("11", 0)
    opposite = {"00": "11", "10": "01", "01": "10", "11": "00"}
    straight = sum((F.when((count(k, 0) == 1) & (count(o, 2) == 1), 1).otherwise(0) for k, o in opposite.items()), F.lit(0))
    kind = F.when(sources == 2, "reciprocal").when(straight == 1, "magnitude").otherwise("sign")
    corners = ("00", "10", "01", "11")
    top = F.greatest(*[F.struct(F.col(f"f{k}").alias("f"), (-F.col(f"n{k}")).alias("neg"), F.lit(k).alias("k")) for k in corners])
    rows = rows.withColumn("kind", kind).withColumn("top", top["k"])
    sums = F.col("f00") + F.col("f11") - F.col("f10") - F.col("f01")
    more = F.when(F.col("top").isin("00", "11"), sums > 0).otherwise(sums < 0)
    two_in = F.lit(False)
    for k in corners:
        two_in = F.when(F.col("top") == k, count(k, 2) == 1).otherwise(two_in)
    return rows.withColumn("whole", two_in).withColumn("positive", F.when(F.col("whole"), more))
