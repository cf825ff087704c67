"""Landscapes over the star-schema tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.plans.landscape import Landscape, build


@dataclass(frozen=True)
class Source:
    """Grouping columns ``(name, kind, Spark SQL, DuckDB SQL)`` of one table, and the fitness aggregate."""

    table: str
    columns: tuple[tuple[str, str, str, str], ...]
    fitness: tuple[str, str]
    kind: str = "default"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        return rows.groupBy(*[F.expr(e).alias(c) for c, _, e, _ in self.columns]).agg(F.expr(self.fitness[0]).cast("double").alias("fitness"))

    def base_sql(self) -> str:
        cols = ", ".join(f"{e} AS {c}" for c, _, _, e in self.columns)
        return f"SELECT {cols}, CAST({self.fitness[1]} AS DOUBLE) AS f FROM {self.table} GROUP BY ALL"


def _cents(c: str) -> str:
    return f"cast(round({c} * 100) as int)"


SOURCES = {
    "l1": Source("lineitem", (("l_returnflag", "categorical", "l_returnflag", "l_returnflag"), ("l_linestatus", "categorical", "l_linestatus", "l_linestatus"), ("discount", "ordinal", _cents("l_discount"), _cents("l_discount")), ("tax", "ordinal", _cents("l_tax"), _cents("l_tax"))), ("max(l_extendedprice)", "max(l_extendedprice)")),
    "l2": Source("part", (("p_type", "categorical", "p_type", "p_type"), ("p_brand", "categorical", "p_brand", "p_brand"), ("size", "ordinal", "cast(p_size div 10 as int)", "cast(p_size // 10 as int)")), ("max(p_retailprice)", "max(p_retailprice)")),
    "l3": Source("embeddings", tuple((f"b{i}", "boolean", f"cast(embedding[{i}] > 0 as int)", f"cast(embedding[{i + 1}] > 0 as int)") for i in range(6)), ("sum(label)", "sum(label)"), "boolean"),
    "l4": Source("events", (("event_type", "categorical", "event_type", "event_type"), ("hour", "ordinal", "hour(ts)", "cast(hour(ts) as int)"), ("day", "ordinal", "dayofweek(ts) - 1", "cast(dayofweek(ts) as int)")), ("count(1)", "count(*)")),
    "l5": Source("lineitem", (("supplier", "categorical", "cast(l_suppkey % 20 as int)", "cast(l_suppkey % 20 as int)"), ("quantity", "ordinal", "cast(l_quantity as int)", "cast(l_quantity as int)"), ("discount", "ordinal", _cents("l_discount"), _cents("l_discount")), ("tax", "ordinal", _cents("l_tax"), _cents("l_tax"))), ("max(l_extendedprice)", "max(l_extendedprice)")),
    "l6": Source("lineitem", tuple((f"b{i}", "boolean", e, e.replace(" div ", " // ")) for i, e in enumerate([*[f"cast(l_quantity as int) div {1 << k} % 2" for k in range(5)], "cast(l_linenumber % 2 as int)", _cents("l_discount") + " % 2", _cents("l_tax") + " % 2", "cast(l_partkey % 2 as int)", "cast(l_suppkey % 2 as int)"])), ("max(l_extendedprice)", "max(l_extendedprice)"), "boolean"),
    "l7": Source("events", (("event_type", "categorical", "event_type", "event_type"), ("hour", "ordinal", "hour(ts)", "cast(hour(ts) as int)"), ("day", "ordinal", "dayofweek(ts) - 1", "cast(dayofweek(ts) as int)")), ("count(1) % 2", "count(*) % 2")),
    "l8": Source("embeddings", tuple((f"b{i}", "boolean", f"cast(embedding[{i}] > 0 as int)", f"cast(embedding[{i + 1}] > 0 as int)") for i in range(16)), ("max(label % 2)", "max(label % 2)"), "boolean"),
    "l9": Source("embeddings", tuple((f"b{i}", "boolean", f"cast(embedding[{i}] > 0 as int)", f"cast(embedding[{i + 1}] > 0 as int)") for i in range(24)), ("sum(label)", "sum(label)"), "boolean"),
}


@lru_cache(maxsize=32)
def _built(app: str, spark: SparkSession, sf_dir: str, name: str, options: tuple, state: tuple) -> Landscape:
    s = SOURCES[name]
    kinds = {c: k for c, k, _, _ in s.columns}
    return build(s.frame(spark, sf_dir), kinds, kind=s.kind, **dict(options))


def _state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """What changes when a table does: its time, bytes and number of files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    size = store.getContentSummary(where)
    return store.getFileStatus(where).getModificationTime(), size.getLength(), size.getFileCount()


def landscape(spark: SparkSession, sf_dir: str, name: str, **options) -> Landscape:
    """A landscape of the catalogue; built once a session and state of its table, as its metrics share its tables."""
    state = _state(spark, f"{sf_dir}/{SOURCES[name].table}.parquet")
    return _built(spark.sparkContext.applicationId, spark, sf_dir, name, tuple(sorted(options.items())), state)


class Sql:
    """Common table expressions of a landscape for DuckDB: enc, pairs, links, edges, neutral and what follows from them."""

    def __init__(self, name: str, maximize: bool = True, epsilon: float = 0.0, where: str = "", tau_both: float | None = None):
        self.source = s = SOURCES[name]
        self.names = [c for c, *_ in s.columns]
        self.p = len(self.names)
        self.ordinal = [k == "ordinal" for _, k, _, _ in s.columns]
        worse = "<" if maximize else ">"
        code = ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS a{i}" for i, c in enumerate(self.names)) if s.kind != "boolean" else ", ".join(f"{c} AS a{i}" for i, c in enumerate(self.names))
        cols, codes = ", ".join(self.names), ", ".join(f"a{i}" for i in range(self.p))
        self.codes = codes
        base = s.base_sql()
        self.ctes = {
            "base": f"SELECT * FROM ({base}) {where}",
            "enc0": f"SELECT row_number() OVER (ORDER BY {cols}) - 1 AS id, {code}, {cols}, f FROM base",
            "linked": self._join("enc0", typed=True, columns="x.id AS u, y.id AS v"),
            "enc": f"SELECT row_number() OVER (ORDER BY id) - 1 AS id, {codes}, {cols}, f FROM enc0 WHERE id IN (SELECT u FROM linked UNION SELECT v FROM linked)",
            "pairs": self._join("enc", typed=False),
            "links": self._join("enc", typed=True),
            "edges": f"SELECT CASE WHEN fu {worse} fv THEN u ELSE v END AS src, CASE WHEN fu {worse} fv THEN v ELSE u END AS dst, abs(fu - fv) AS d FROM links WHERE abs(fu - fv) > {epsilon!r}",
            "neutral": f"SELECT least(u, v) AS u, greatest(u, v) AS v FROM links WHERE abs(fu - fv) <= {epsilon!r}",
            "deg": "SELECT id, coalesce(i, 0) AS ind, coalesce(o, 0) AS outd FROM enc LEFT JOIN (SELECT dst, count(*) AS i FROM edges GROUP BY 1) ON dst = id LEFT JOIN (SELECT src, count(*) AS o FROM edges GROUP BY 1) ON src = id",
            "sym": "SELECT src AS id, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges UNION ALL SELECT u, v FROM neutral UNION ALL SELECT v, u FROM neutral",
            "nbf": "SELECT e.id, e.f, m FROM enc e LEFT JOIN (SELECT s.id, avg(x.f) AS m FROM sym s JOIN enc x ON x.id = s.o GROUP BY 1) q ON q.id = e.id",
            "closure(id, r)": "SELECT id, id FROM enc UNION SELECT c.id, n.o FROM closure c JOIN (SELECT u AS id, v AS o FROM neutral UNION SELECT v, u FROM neutral) n ON n.id = c.r",
            "plat": "SELECT id, min(r) AS root, count(*) AS size FROM closure GROUP BY 1",
            "lo": "SELECT p.id, p.root, p.size, max(d.outd) OVER (PARTITION BY p.root) = 0 AS is_lo FROM plat p JOIN deg d ON d.id = p.id",
            "succ": "SELECT src AS id, arg_max(dst, (x.f, -dst)) AS t FROM edges JOIN enc x ON x.id = dst GROUP BY 1",
            "exits": "SELECT p.root, arg_min(e.dst, (e.src, e.dst)) AS t FROM edges e JOIN plat p ON p.id = e.src JOIN plat q ON q.id = e.dst WHERE p.root <> q.root AND p.size > 1 GROUP BY 1",
            "nxt": "SELECT e.id, coalesce(s.t, CASE WHEN p.size > 1 THEN x.t END) AS t FROM enc e LEFT JOIN succ s ON s.id = e.id JOIN plat p ON p.id = e.id LEFT JOIN exits x ON x.root = p.root",
            "climb(start, id, steps)": "SELECT id, id, 0 FROM enc UNION ALL SELECT c.start, n.t, c.steps + 1 FROM climb c JOIN nxt n ON n.id = c.id WHERE n.t IS NOT NULL",
            "basin": "SELECT start AS id, CASE WHEN s.is_lo THEN s.root ELSE arg_max(l.root, c.steps) END AS b, CASE WHEN s.is_lo THEN 0 ELSE max(c.steps) END AS steps FROM climb c JOIN lo l ON l.id = c.id JOIN lo s ON s.id = c.start GROUP BY c.start, s.is_lo, s.root",
            "sizes": "SELECT b AS id, count(*) AS size, max(steps) AS radius FROM basin GROUP BY 1",
            "go": f"SELECT id FROM enc ORDER BY f {'DESC' if maximize else ''}, id LIMIT 1",
            "dgo": f"SELECT e.id, e.f, min({' + '.join(f'abs(e.a{i} - g.a{i})' if o and s.kind != 'boolean' else f'(e.a{i} <> g.a{i})::INT' for i, o in enumerate(self.ordinal))}) AS d FROM enc e, (SELECT * FROM enc WHERE f = (SELECT {'max' if maximize else 'min'}(f) FROM enc)) g GROUP BY ALL",
            "togo(id, d)": "SELECT id, 0 FROM go UNION SELECT e.src, t.d + 1 FROM togo t JOIN edges e ON e.dst = t.id",
            "godist": "SELECT id, min(d) AS d FROM togo GROUP BY 1",
            "anc(peak, id)": "SELECT root, id FROM lo WHERE is_lo UNION SELECT a.peak, e.src FROM anc a JOIN edges e ON e.dst = a.id",
            "sq": self._squares(False),
            "tsq": self._squares(True),
        }

    def _join(self, table: str, typed: bool, columns: str | None = None) -> str:
        parts = []
        for i in range(self.p):
            rest = " AND ".join(f"x.a{j} = y.a{j}" for j in range(self.p) if j != i)
            own = f"y.a{i} = x.a{i} + 1" if typed and self.ordinal[i] and self.source.kind != "boolean" else f"x.a{i} < y.a{i}"
            cols = columns or f"{i} AS p, x.id AS u, y.id AS v, x.a{i} AS a, y.a{i} AS b, x.f AS fu, y.f AS fv"
            parts.append(f"SELECT {cols} FROM {table} x JOIN {table} y ON {rest} AND {own}")
        return " UNION ALL ".join(parts)

    def _squares(self, typed: bool) -> str:
        parts = []
        step = lambda x, y, i: f"{y}.a{i} = {x}.a{i} + 1" if typed and self.ordinal[i] and self.source.kind != "boolean" else f"{x}.a{i} < {y}.a{i}"
        for p in range(self.p):
            for q in range(p + 1, self.p):
                rest = [j for j in range(self.p) if j not in (p, q)]
                same = lambda x, y, but: " AND ".join(f"{x}.a{j} = {y}.a{j}" for j in (*rest, but))
                parts.append(
                    f"SELECT {p} AS p, {q} AS q, w.id AS n00, x.id AS n10, y.id AS n01, z.id AS n11, w.f AS f00, x.f AS f10, y.f AS f01, z.f AS f11 FROM enc w "
                    f"JOIN enc x ON {same('w', 'x', q)} AND {step('w', 'x', p)} JOIN enc y ON {same('w', 'y', p)} AND {step('w', 'y', q)} JOIN enc z ON {same('x', 'z', p)} AND {same('y', 'z', q)}"
                )
        return " UNION ALL ".join(parts)

    def query(self, select: str, extra: dict[str, str] | None = None) -> str:
        """``select`` with the expressions it needs, in order."""
        ctes = self.ctes | (extra or {})
        names = list(ctes)
        need: set[str] = set()

        def visit(sql: str) -> None:
            import re

            words = set(re.findall(r"\w+", sql))
            for n in names:
                if n.split("(")[0] in words and n not in need:
                    need.add(n)
                    visit(ctes[n])

        visit(select)
        return "WITH RECURSIVE " + ", ".join(f"{n} AS ({ctes[n]})" for n in names if n in need) + f" {select}"
