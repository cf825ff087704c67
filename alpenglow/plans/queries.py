"""The registered landscape queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.functions import plots, stats
from alpenglow.operators import bitreach, neighbours
from alpenglow.plans import metrics as M
from alpenglow.plans.catalog import SOURCES, Sql, landscape
from alpenglow.plans.filters import RowFilter, Rule
from alpenglow.plans.landscape import build
from alpenglow.plans.profile import list_metrics, profile
from alpenglow.plans.cut import fresh
from alpenglow.sources import ingest, problems, store
from alpenglow.sources.handlers import Handlers, InputHandler

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_CAST = {"l": ("long", "BIGINT"), "d": ("double", "DOUBLE"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN")}


def _add(name: str, spec: str, made: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Register a query with columns ``name:type``; both sides are cast alike, and doubles rounded to 6 digits."""
    columns = [c.split(":") for c in spec.split()]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = made(spark, sf_dir)
        cast = lambda c, t: F.round(F.col(f"`{c}`").cast("double"), 6) + F.lit(0.0) if t == "d" else F.col(f"`{c}`").cast(_CAST[t][0])
        return df.select(*[cast(c, t).alias(c) for c, t in columns])

    QUERIES[name] = run
    if sql is not None:
        cast_sql = lambda c, t: f'round(CAST("{c}" AS DOUBLE), 6) + 0.0' if t == "d" else f'CAST("{c}" AS {_CAST[t][1]})'
        SQL[name] = f"SELECT {', '.join(f'{cast_sql(c, t)} AS "{c}"' for c, t in columns)} FROM ({sql})"


def _land(name: str, **options):
    return lambda spark, sf: landscape(spark, sf, name, **options)


def _of(name: str, metric: Callable, **arguments) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: metric(landscape(spark, sf, name), **arguments)


L = {n: Sql(n) for n in SOURCES}
RANK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"
CORR = "CASE WHEN stddev_pop({0}) > 0 AND stddev_pop({1}) > 0 THEN corr({0}, {1}) END"


def _spearman(x: str, y: str, rows: str) -> str:
    return f"SELECT {CORR.format('rx', 'ry')} AS value FROM (SELECT {RANK.format(x)} AS rx, {RANK.format(y)} AS ry FROM {rows})"


# construction

for n in ("l1", "l2"):
    names, kinds = L[n].names, {"l1": "ssll", "l2": "ssl"}[n]
    codes = [f"a{i}" for i in range(len(names))]
    spec = " ".join(["node_id:l", *[f"{c}:l" for c in codes], *[f"{c}:{k}" for c, k in zip(names, kinds)], "fitness:d"])
    shown = lambda spark, sf, n=n, codes=codes: landscape(spark, sf, n).nodes.select("*", *[F.element_at("cfg", i + 1).alias(c) for i, c in enumerate(codes)])
    _add(f"encode_{n}", spec, shown, L[n].query(f"SELECT id AS node_id, {', '.join(codes + names)}, f AS fitness FROM enc"))
for n in ("l1", "l3"):
    _add(f"hamming_pairs_{n}", "p:l u:l v:l a:l b:l", lambda spark, sf, n=n: landscape(spark, sf, n).hamming, L[n].query("SELECT p, u, v, a, b FROM pairs"))
_two = " + ".join(f"(x.a{i} <> y.a{i})::INT" for i in range(6))
_add("hamming2_pairs_l3", "u:l v:l", lambda spark, sf: (lambda x: neighbours.edit_pairs(x.nodes, x.variables, 2))(landscape(spark, sf, "l3")), L["l3"].query(f"SELECT x.id AS u, y.id AS v FROM enc x JOIN enc y ON x.id < y.id AND {_two} <= 2"))
for n in ("l1", "l2", "l3", "l4"):
    _add(f"improving_edges_{n}", "src:l dst:l delta_fit:d", lambda spark, sf, n=n: landscape(spark, sf, n).edges, L[n].query("SELECT src, dst, d AS delta_fit FROM edges"))
for n in ("l2", "l4"):
    _add(f"neutral_pairs_{n}", "u:l v:l", lambda spark, sf, n=n: landscape(spark, sf, n).neutral, L[n].query("SELECT u, v FROM neutral"))
_min, _eps = Sql("l1", maximize=False), Sql("l1", epsilon=500.005)
_add("edges_min_l1", "src:l dst:l delta_fit:d", lambda spark, sf: landscape(spark, sf, "l1", maximize=False).edges, _min.query("SELECT src, dst, d AS delta_fit FROM edges"))
_add("edges_eps_l1", "src:l dst:l delta_fit:d", lambda spark, sf: landscape(spark, sf, "l1", epsilon=500.005).edges, _eps.query("SELECT src, dst, d AS delta_fit FROM edges"))
_add("neutral_eps_l1", "u:l v:l", lambda spark, sf: landscape(spark, sf, "l1", epsilon=500.005).neutral, _eps.query("SELECT u, v FROM neutral"))
_nodes1 = "node_id:l l_returnflag:s l_linestatus:s discount:l tax:l fitness:d"
_shown1 = "id AS node_id, l_returnflag, l_linestatus, discount, tax, f AS fitness"
_add("tau_any_l1", _nodes1, lambda spark, sf: landscape(spark, sf, "l1", tau=103000.0).nodes, Sql("l1", where="WHERE f >= 103000").query(f"SELECT {_shown1} FROM enc"))
_both = {
    "held": "SELECT src, dst FROM edges JOIN enc a ON a.id = src JOIN enc b ON b.id = dst WHERE a.f >= 104500 OR b.f >= 104500",
    "cc(id, r)": "SELECT id, id FROM enc UNION SELECT c.id, n.o FROM cc c JOIN (SELECT src AS id, dst AS o FROM held UNION ALL SELECT dst, src FROM held) n ON n.id = c.r",
    "roots": "SELECT id, min(r) AS root FROM cc GROUP BY 1",
    "giant": "SELECT root FROM roots GROUP BY 1 ORDER BY count(*) DESC, root LIMIT 1",
}
_add("tau_both_l1", _nodes1, lambda spark, sf: landscape(spark, sf, "l1", tau=104500.0, filter_mode="both").nodes, L["l1"].query(f"SELECT {_shown1.replace('id AS', 'row_number() OVER (ORDER BY id) - 1 AS')} FROM enc WHERE id IN (SELECT id FROM roots WHERE root IN (SELECT root FROM giant))", _both))


def _rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = SOURCES["l2"].frame(spark, sf)
    keep = RowFilter((Rule("size", ">=", 2), Rule("p_type", "contains", "A"), Rule("p_brand", "not_in", ["Brand#11"]), Rule("absent", "==", 1)))
    return build(rows, {"p_type": "categorical", "p_brand": "categorical", "size": "ordinal"}, rules=keep).nodes


_add("rule_filter_l2", "node_id:l p_type:s p_brand:s size:l fitness:d", _rules, Sql("l2", where="WHERE size >= 2 AND contains(p_type, 'A') AND p_brand <> 'Brand#11'").query("SELECT id AS node_id, p_type, p_brand, size, f AS fitness FROM enc"))


def _isolated(spark: SparkSession, sf: str) -> DataFrame:
    whole = landscape(spark, sf, "l2", keep_isolated=True).nodes
    return whole.join(landscape(spark, sf, "l2").nodes, ["p_type", "p_brand", "size"], "left_anti")


_add("isolated_l2", "p_type:s p_brand:s size:l fitness:d", _isolated, L["l2"].query("SELECT p_type, p_brand, size, f AS fitness FROM enc0 WHERE id NOT IN (SELECT u FROM linked UNION SELECT v FROM linked)"))

# structure

for n in ("l1", "l4"):
    _add(f"degrees_{n}", "node_id:l in_degree:l out_degree:l", lambda spark, sf, n=n: landscape(spark, sf, n).degrees, L[n].query("SELECT id AS node_id, ind AS in_degree, outd AS out_degree FROM deg"))
    _add(f"basins_{n}", "node_id:l basin_index:l steps:l", lambda spark, sf, n=n: landscape(spark, sf, n).basins, L[n].query("SELECT id AS node_id, b AS basin_index, steps FROM basin"))
    _add(f"basin_sizes_{n}", "node_id:l size_basin_greedy:l radius_basin_greedy:l", lambda spark, sf, n=n: landscape(spark, sf, n).basin_sizes, L[n].query("SELECT id AS node_id, size AS size_basin_greedy, radius AS radius_basin_greedy FROM sizes"))
for n in ("l2", "l4"):
    _add(f"plateaus_{n}", "node_id:l plateau_id:l plateau_size:l", lambda spark, sf, n=n: landscape(spark, sf, n).plateaus, L[n].query("SELECT id AS node_id, CASE WHEN size > 1 THEN dense_rank() OVER (ORDER BY CASE WHEN size > 1 THEN root END NULLS LAST) - 1 ELSE -1 END AS plateau_id, size AS plateau_size FROM plat"))
for n in ("l1", "l2", "l3", "l4"):
    _add(f"local_optima_{n}", "node_id:l is_lo:b peak:l", lambda spark, sf, n=n: landscape(spark, sf, n).optima, L[n].query("SELECT id AS node_id, is_lo, root AS peak FROM lo"))
_add("local_optima_min_l1", "node_id:l is_lo:b peak:l", lambda spark, sf: landscape(spark, sf, "l1", maximize=False).optima, _min.query("SELECT id AS node_id, is_lo, root AS peak FROM lo"))
_add("global_optimum_l1", "node_id:l fitness:d", lambda spark, sf: (lambda x: x.nodes.where(F.col("node_id") == x.go_index))(landscape(spark, sf, "l1")), L["l1"].query("SELECT id AS node_id, f AS fitness FROM enc WHERE id = (SELECT id FROM go)"))
for n in ("l1", "l3"):
    _add(f"accessible_basins_{n}", "peak:l size:l", lambda spark, sf, n=n: bitreach.sizes(landscape(spark, sf, n).ancestor_counts).withColumnRenamed("key", "peak"), L[n].query("SELECT peak, count(DISTINCT id) AS size FROM anc GROUP BY 1"))
    _add(f"dist_to_go_{n}", "node_id:l dist_go:l", lambda spark, sf, n=n: landscape(spark, sf, n).dist_to_go, L[n].query("SELECT id AS node_id, d AS dist_go FROM dgo"))
_add("neighbor_fitness_l1", "node_id:l mean_neighbor_fit:d", lambda spark, sf: landscape(spark, sf, "l1").neighbour_fitness, L["l1"].query("SELECT id AS node_id, m AS mean_neighbor_fit FROM nbf"))
_add("degree_histogram_l5", "in_degree:l out_degree:l n:l", lambda spark, sf: landscape(spark, sf, "l5").degrees.groupBy("in_degree", "out_degree").agg(F.count(F.lit(1)).alias("n")), L["l5"].query("SELECT ind AS in_degree, outd AS out_degree, count(*) AS n FROM deg GROUP BY ALL"))
_data = "SELECT e.id AS node_id, event_type, hour, day, f AS fitness, is_lo, CASE WHEN p.size > 1 THEN dense_rank() OVER (ORDER BY CASE WHEN p.size > 1 THEN p.root END NULLS LAST) - 1 ELSE -1 END AS plateau_id, p.size AS plateau_size, ind AS in_degree, outd AS out_degree, b AS basin_index FROM enc e JOIN lo l ON l.id = e.id JOIN plat p ON p.id = e.id JOIN deg g ON g.id = e.id JOIN basin n ON n.id = e.id"
_add("get_data_l4", "node_id:l event_type:s hour:l day:l fitness:d is_lo:b plateau_id:l plateau_size:l in_degree:l out_degree:l basin_index:l", lambda spark, sf: landscape(spark, sf, "l4").get_data(), L["l4"].query(_data))
_add("get_data_lo_l3", "node_id:l fitness:d size_basin_greedy:l size_basin_accessible:l", lambda spark, sf: landscape(spark, sf, "l3").get_data(lo_only=True), L["l3"].query("SELECT e.id AS node_id, f AS fitness, s.size AS size_basin_greedy, a.n AS size_basin_accessible FROM lo l JOIN enc e ON e.id = l.id JOIN sizes s ON s.id = l.root JOIN (SELECT peak, count(DISTINCT id) AS n FROM anc GROUP BY 1) a ON a.peak = l.root WHERE is_lo"))

# one-pass metrics

_V = "value:d"
_add("local_optima_ratio_l1", _V, _of("l1", M.local_optima_ratio), L["l1"].query("SELECT count(*) FILTER (WHERE is_lo AND id = root) / count(*) AS value FROM lo"))
_add("gradient_intensity_l1", _V, _of("l1", M.gradient_intensity), L["l1"].query("SELECT (SELECT avg(d) FROM edges) / (SELECT avg(f) FROM enc) AS value"))
_add("neutrality_l4", _V, _of("l4", M.neutrality), L["l4"].query("SELECT avg((abs(a.f - b.f) <= 0.01)::INT) AS value FROM sym s JOIN enc a ON a.id = s.id JOIN enc b ON b.id = s.o"))
_add("evolvability_l1", _V, _of("l1", M.evolvability_enhancing_mutations), L["l1"].query("SELECT avg((b.m - a.m > 0)::INT) AS value FROM edges JOIN nbf a ON a.id = src JOIN nbf b ON b.id = dst"))
_add("nfc_l1", _V, _of("l1", M.neighbor_fitness_correlation), L["l1"].query("SELECT corr(f, m) AS value FROM nbf WHERE m IS NOT NULL"))
for n in ("l1", "l4"):
    _add(f"fdc_{n}", _V, _of(n, M.fdc), L[n].query(_spearman("d", "f", "dgo")))
_add("fdc_pearson_l1", _V, _of("l1", M.fdc, method="pearson"), L["l1"].query("SELECT corr(d, f) AS value FROM dgo"))
_add("fdc_kendall_l3", _V, _of("l3", M.fdc, method="kendall"), L["l3"].query("SELECT sum(sign(x.d - y.d) * sign(x.f - y.f)) / sqrt(sum((x.d <> y.d)::INT) * sum((x.f <> y.f)::INT)::DOUBLE) AS value FROM dgo x JOIN dgo y ON x.id < y.id"))
_add("mean_distance_l1", _V, _of("l1", M.mean_distance_to_global_optimum), L["l1"].query("SELECT avg(d) AS value FROM dgo"))
_add("basin_fitness_corr_l1", _V, _of("l1", M.basin_fitness_correlation), L["l1"].query(_spearman("s", "f", "(SELECT e.f, coalesce(z.size, 0) AS s FROM lo JOIN enc e ON e.id = lo.id LEFT JOIN sizes z ON z.id = lo.id WHERE is_lo)")))
_add("go_accessibility_l1", _V, _of("l1", M.global_optima_accessibility), L["l1"].query("SELECT (SELECT count(*) FROM godist) / (SELECT count(*) FROM enc) AS value"))
_add("path_length_l1", "mean:d variance:d", _of("l1", M.mean_path_length_to_global_optimum), L["l1"].query("SELECT avg(d) AS mean, var_pop(d) AS variance FROM godist"))
_reach = {"ra(k, id)": "SELECT id, id FROM lo WHERE is_lo UNION SELECT a.k, e.src FROM ra a JOIN edges e ON e.dst = a.id"}
_add("lo_accessibility_l3", "node_id:l accessibility:d", _of("l3", M.local_optima_accessibility), L["l3"].query("SELECT k AS node_id, count(*) / (SELECT count(*) FROM enc) AS accessibility FROM ra GROUP BY 1", _reach))
_dist = {"rd(k, id, d)": "SELECT id, id, 0 FROM lo WHERE is_lo UNION SELECT a.k, e.src, a.d + 1 FROM rd a JOIN edges e ON e.dst = a.id"}
_add("lo_path_lengths_l3", "node_id:l mean:d variance:d", _of("l3", M.mean_path_length_to_local_optima), L["l3"].query("SELECT k AS node_id, avg(d) AS mean, var_pop(d) AS variance FROM (SELECT k, id, min(d) AS d FROM rd GROUP BY ALL) GROUP BY 1", _dist))
_hd = " + ".join(f"(e.a{i} <> g.a{i})::INT" for i in range(6))
_add("lo_distances_l3", "node_id:l mean_distance:d", _of("l3", M.mean_distance_to_local_optima), L["l3"].query(f"SELECT g.id AS node_id, avg({_hd}) AS mean_distance FROM lo JOIN enc g ON g.id = lo.id CROSS JOIN enc e WHERE is_lo GROUP BY 1"))
_path = {
    "pc(start, id, step)": "SELECT id, id, 0 FROM enc UNION ALL SELECT c.start, s.t, c.step + 1 FROM pc c JOIN succ s ON s.id = c.id",
    "ended": "SELECT start FROM pc WHERE id = (SELECT id FROM go)",
    "gains": "SELECT start, step, f - lag(f) OVER (PARTITION BY start ORDER BY step) AS g, count(*) OVER (PARTITION BY start) AS n FROM pc JOIN enc e ON e.id = pc.id WHERE start IN (SELECT start FROM ended)",
    "ranked": "SELECT start, step, rank() OVER (PARTITION BY start ORDER BY g) + (count(*) OVER (PARTITION BY start, g) - 1) / 2.0 AS r FROM gains WHERE n >= 3 AND step > 0",
}
for n in ("l1", "l3"):
    _add(f"flattening_{n}", _V, _of(n, M.fitness_flattening_index), L[n].query(f"SELECT avg(c) AS value FROM (SELECT {CORR.format('step', 'r')} AS c FROM ranked GROUP BY start)", _path))
_walked = "SELECT step, avg(f) AS mean_fitness, count(*) AS alive FROM pc JOIN enc e ON e.id = pc.id GROUP BY 1"
_add("adaptive_walks_l1", "step:l mean_fitness:d alive:l", _of("l1", plots.adaptive_walks), L["l1"].query(_walked, _path))

# fitness and mutations

_mom = """SELECT m3 / pow(m2, 1.5) AS skewness, m4 / (m2 * m2) AS kurtosis, sd / abs(mu) AS cv, (q3 - q1) / abs(md) AS quartile_coefficient, md / mu AS median_mean_ratio, (hi - lo_) / abs(md) AS relative_range
FROM (SELECT avg(pow(f - mu, 2)) AS m2, avg(pow(f - mu, 3)) AS m3, avg(pow(f - mu, 4)) AS m4, any_value(mu) AS mu, stddev_samp(f) AS sd, quantile_cont(f, 0.25) AS q1, quantile_cont(f, 0.5) AS md, quantile_cont(f, 0.75) AS q3, min(f) AS lo_, max(f) AS hi FROM enc, (SELECT avg(f) AS mu FROM enc))"""
_add("fitness_distribution_l1", "skewness:d kurtosis:d cv:d quartile_coefficient:d median_mean_ratio:d relative_range:d", _of("l1", M.fitness_distribution, cauchy=False), L["l1"].query(_mom))
_pos = "list_extract(['l_returnflag', 'l_linestatus', 'discount', 'tax'], p + 1)"
_eff = {
    "eff": f"SELECT {_pos} AS position, a, b, quantile_cont(abs(fu - fv), 0.5) AS m, avg(fu - fv) AS mean_effect, count(*) AS n, count(*) FILTER (WHERE fu > fv) AS k FROM pairs GROUP BY ALL",
    "tails": "SELECT position, a, b, least(1, sum(CASE WHEN i >= k THEN exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)) ELSE 0 END)) AS p_value FROM (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT position, a, b, n, k FROM eff)) GROUP BY ALL",
}
_add("mutation_effects_l1", "position:s allele_a:l allele_b:l median_abs_effect:d mean_effect:d p_value:d significant:b", _of("l1", M.mutation_effects), L["l1"].query("SELECT eff.position, eff.a AS allele_a, eff.b AS allele_b, m / (SELECT stddev_samp(f) FROM enc) AS median_abs_effect, mean_effect, p_value, p_value < 0.05 AS significant FROM eff JOIN tails t ON t.position = eff.position AND t.a = eff.a AND t.b = eff.b", _eff))
_add("dfe_l1", "effect:d", _of("l1", M.fitness_effect_distribution, mutation=("R", "l_returnflag", "A")), L["l1"].query("SELECT y.f - x.f AS effect FROM enc x JOIN enc y ON x.l_linestatus = y.l_linestatus AND x.discount = y.discount AND x.tax = y.tax WHERE x.l_returnflag = 'R' AND y.l_returnflag = 'A'"))
_add("idiosyncratic_l1", _V, _of("l1", M.idiosyncratic_index, mutation=("F", "l_linestatus", "O")), L["l1"].query("SELECT stddev_pop(fv - fu) / (sqrt(2) * (SELECT stddev_pop(f) FROM enc)) AS value FROM pairs WHERE p = 1"))
_add("global_idiosyncratic_l1", _V, _of("l1", M.global_idiosyncratic_index), L["l1"].query("SELECT avg(i) AS value FROM (SELECT stddev_pop(fv - fu) / (sqrt(2) * (SELECT stddev_pop(f) FROM enc)) AS i FROM pairs GROUP BY p, a, b HAVING count(*) >= 3)"))
for end, name, metric in (("src", "diminishing_returns", M.diminishing_returns_index), ("dst", "increasing_costs", M.increasing_costs_index)):
    means = f"(SELECT e.f, avg(d) AS m FROM edges JOIN enc e ON e.id = {end} GROUP BY {end}, e.f)"
    _add(f"{name}_l1", _V, _of("l1", metric), L["l1"].query(f"SELECT corr(f, m) AS value FROM {means}"))
    _add(f"{name}_slope_l1", _V, _of("l1", metric, method="regression"), L["l1"].query(f"SELECT regr_slope(m, f) AS value FROM {means}"))
_add("combined_effects_l1", "effect:d", _of("l1", plots.combined_effects, changes={"l_returnflag": ("R", "A"), "l_linestatus": ("F", "O")}), L["l1"].query("SELECT y.f - x.f AS effect FROM enc x JOIN enc y ON x.discount = y.discount AND x.tax = y.tax WHERE x.l_returnflag = 'R' AND y.l_returnflag = 'A' AND x.l_linestatus = 'F' AND y.l_linestatus = 'O'"))

# squares

_b1, _b2, _c1, _c2 = "(f10 - f00)", "(f11 - f01)", "(f01 - f00)", "(f11 - f10)"
_gamma = f"SELECT sum({_b1} * {_b2} + {_c1} * {_c2}) / sum(({_b1} * {_b1} + {_b2} * {_b2} + {_c1} * {_c1} + {_c2} * {_c2}) / 2) AS value FROM sq"
_sign = lambda x: f"sign({x})"
_gstar = f"SELECT sum({_sign(_b1)} * {_sign(_b2)} + {_sign(_c1)} * {_sign(_c2)}) / sum((abs({_sign(_b1)}) + abs({_sign(_b2)}) + abs({_sign(_c1)}) + abs({_sign(_c2)})) / 2.0) AS value FROM sq"
_four = {
    "four": "SELECT *, (f10 > f00)::INT AS e1, (f11 > f01)::INT AS e2, (f01 > f00)::INT AS e3, (f11 > f10)::INT AS e4 FROM tsq WHERE f10 <> f00 AND f11 <> f01 AND f01 <> f00 AND f11 <> f10",
    "ins": "SELECT *, 2 - e1 - e3 AS i00, e1 + 1 - e4 AS i10, 1 - e2 + e3 AS i01, e2 + e4 AS i11 FROM four",
    "kinds": "SELECT *, CASE WHEN (i00 = 0)::INT + (i10 = 0)::INT + (i01 = 0)::INT + (i11 = 0)::INT = 2 THEN 'r' WHEN (i00 = 0 AND i11 = 2) OR (i11 = 0 AND i00 = 2) OR (i10 = 0 AND i01 = 2) OR (i01 = 0 AND i10 = 2) THEN 'm' ELSE 's' END AS kind, CASE WHEN f11 > f10 AND f11 > f01 AND (f11 > f00) OR f00 > f10 AND f00 > f01 AND f00 >= f11 THEN f00 + f11 > f10 + f01 WHEN f11 > f10 AND f11 > f01 AND f00 > f10 AND f00 > f01 THEN f00 + f11 > f10 + f01 WHEN greatest(f00, f11) > greatest(f10, f01) THEN f00 + f11 > f10 + f01 ELSE f00 + f11 < f10 + f01 END AS pos FROM ins",
}
_classes = "SELECT count(*) FILTER (WHERE kind = 'm') / count(*) AS magnitude, count(*) FILTER (WHERE kind = 's') / count(*) AS sign, count(*) FILTER (WHERE kind = 'r') / count(*) AS reciprocal_sign, count(*) FILTER (WHERE pos) / count(*) AS positive, 1 - count(*) FILTER (WHERE pos) / count(*) AS negative FROM kinds"
for n in ("l1", "l3"):
    _add(f"gamma_{n}", _V, _of(n, M.gamma), L[n].query(_gamma))
    _add(f"gamma_star_{n}", _V, _of(n, M.gamma_star), L[n].query(_gstar))
    _add(f"epistasis_classes_{n}", "magnitude:d sign:d reciprocal_sign:d positive:d negative:d", _of(n, M.classify_epistasis), L[n].query(_classes, _four))
_bypass = _four | {
    "rec": "SELECT CASE WHEN greatest(f00, f11) > greatest(f10, f01) OR (greatest(f00, f11) = greatest(f10, f01) AND least(CASE WHEN f00 >= f11 THEN n00 ELSE n11 END, CASE WHEN f11 >= f00 THEN n11 ELSE n00 END) < least(CASE WHEN f10 >= f01 THEN n10 ELSE n01 END, CASE WHEN f01 >= f10 THEN n01 ELSE n10 END)) THEN CASE WHEN f00 > f11 OR (f00 = f11 AND n00 < n11) THEN n00 ELSE n11 END ELSE CASE WHEN f10 > f01 OR (f10 = f01 AND n10 < n01) THEN n10 ELSE n01 END END AS t, n00, n10, n01, n11 FROM kinds WHERE kind = 'r'",
    "want": "SELECT t, CASE t WHEN n00 THEN n11 WHEN n11 THEN n00 WHEN n10 THEN n01 ELSE n10 END AS s FROM rec",
    "go_on(s, id, d)": "SELECT DISTINCT s, s, 0 FROM want UNION SELECT g.s, e.dst, g.d + 1 FROM go_on g JOIN edges e ON e.src = g.id",
    "dists": "SELECT s, id, min(d) AS d FROM go_on GROUP BY ALL",
}
_add("bypass_l3", "bypass_proportion:d average_bypass_length:d total_motifs:l motifs_with_bypass:l", _of("l3", M.extradimensional_bypass), L["l3"].query("SELECT count(d) / count(*) AS bypass_proportion, avg(d) AS average_bypass_length, count(*) AS total_motifs, count(d) AS motifs_with_bypass FROM want LEFT JOIN dists ON dists.s = want.s AND dists.id = want.t", _bypass))

# least squares on the complete cube, where the fits have closed forms

_sgn = lambda s: " * ".join(f"(2 * a{i} - 1)" for i in s) or "1"
_subsets = [s for k in range(3) for s in combinations(range(6), k)]
_rs = f"SELECT sqrt(var_pop(f) - ({' + '.join(f'pow(avg(f * {_sgn((i,))}), 2)' for i in range(6))})) / (({' + '.join(f'abs(2 * avg(f * {_sgn((i,))}))' for i in range(6))}) / 6) AS value FROM enc"
_add("rs_ratio_l3", _V, _of("l3", M.r_s_ratio), L["l3"].query(_rs))
_add("r2_order2_l3", _V, _of("l3", M.higher_order_epistasis), L["l3"].query(f"SELECT ({' + '.join(f'pow(avg(f * {_sgn(s)}), 2)' for s in _subsets if s)}) / var_pop(f) AS value FROM enc"))
_terms = " UNION ALL ".join(f"SELECT {len(s)} AS \"order\", '{'-'.join(f'0_{i + 1}_1' for i in s)}' AS term, avg(f * {_sgn(s)}) * {2 ** len(s)} AS coefficient FROM enc" for s in _subsets)
_add("walsh_l3", "order:l term:s coefficient:d", _of("l3", M.walsh_hadamard), L["l3"].query(_terms))

# networks

_edit = " + ".join(f"(x.a{i} <> y.a{i})::INT" for i in range(4))
_near = " AND ".join(f"abs(x.a{i} - y.a{i}) <= 1" for i in (2, 3))
_lon = {
    "esc": f"SELECT x.id AS src, b.b AS dst, count(*) AS w FROM lo JOIN enc x ON x.id = lo.id JOIN enc y ON {_edit} = 2 AND {_near} JOIN basin b ON b.id = y.id WHERE is_lo AND lo.id = lo.root GROUP BY ALL HAVING count(*) > 1",
    "lone": "SELECT src, dst, w, a.f AS f1, b.f AS f2 FROM esc JOIN enc a ON a.id = src JOIN enc b ON b.id = dst WHERE src <> dst",
}
_add("lon_edges_l1", "src:l dst:l weight:l", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1, mlon=False).edges, L["l1"].query("SELECT src, dst, w AS weight FROM lone", _lon))
_add("mlon_edges_l1", "src:l dst:l weight:l", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1).edges, L["l1"].query("SELECT src, dst, w AS weight FROM lone WHERE f2 >= f1", _lon))
_add("mlon_trimmed_l1", "src:l dst:l weight:l", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1, trim=1).edges, L["l1"].query("SELECT src, dst, w AS weight FROM lone WHERE f2 >= f1 QUALIFY row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) = 1", _lon))
_add("lon_nodes_l1", "peak:l fitness:d size_basin_greedy:l escape_difficulty:d improve_rate:d", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1).nodes, L["l1"].query("SELECT e.id AS peak, e.f AS fitness, z.size AS size_basin_greedy, coalesce(q.esc, 1) AS escape_difficulty, coalesce(i.imp, 0) AS improve_rate FROM lo JOIN enc e ON e.id = lo.id JOIN sizes z ON z.id = lo.id LEFT JOIN (SELECT src, CASE WHEN sum(CASE WHEN src <> dst THEN w ELSE 0 END) > 0 THEN sum(CASE WHEN src = dst THEN w ELSE 0 END) / sum(w) ELSE 1 END AS esc FROM esc GROUP BY 1) q ON q.src = e.id LEFT JOIN (SELECT src, sum(CASE WHEN f2 > f1 THEN w ELSE 0 END) / sum(w) AS imp FROM lone GROUP BY 1) i ON i.src = e.id WHERE is_lo AND lo.id = lo.root", _lon))
_add("edge_correlation_l3", _V, _of("l3", M.edge_correlation), L["l3"].query("SELECT corr(a.f, b.f) AS value FROM (SELECT src AS id, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges) s JOIN enc a ON a.id = s.id JOIN enc b ON b.id = s.o"))

# generators

_add("eggbox_landscape", "config:s fitness:d", lambda spark, sf: problems.Eggbox(10, 0.3).get_data(spark), "SELECT lpad(bin(i), 10, '0') AS config, pow(sin(0.3 * bit_count(i) * pi()), 2) AS fitness FROM (SELECT unnest(range(0, 1024)) AS i)")
_additive = problems.Additive(8, seed=3)
_add("additive_landscape", "config:s fitness:d", lambda spark, sf: problems.Additive(8, seed=3).get_data(spark), f"SELECT lpad(bin(i), 8, '0') AS config, {' + '.join(f'CASE WHEN (i >> {7 - j}) & 1 = 1 THEN {b!r} ELSE {a!r} END' for j, (a, b) in enumerate(_additive.parts))} AS fitness FROM (SELECT unnest(range(0, 256)) AS i)")
_sack = problems.Knapsack(9, seed=5)
_total = lambda xs: " + ".join(f"((i >> {8 - j}) & 1) * {x}" for j, x in enumerate(xs))
_add("knapsack_landscape", "config:s fitness:d", lambda spark, sf: problems.Knapsack(9, seed=5).get_data(spark), f"SELECT lpad(bin(i), 9, '0') AS config, CASE WHEN {_total(_sack.weights)} > {_sack.capacity} THEN 0 ELSE {_total(_sack.values)} END AS fitness FROM (SELECT unnest(range(0, 512)) AS i)")
_bit = lambda n, j: f"((i >> {n - 1 - j}) & 1)"
_cube = lambda n, fitness: f"SELECT lpad(bin(i), {n}, '0') AS config, {fitness} AS fitness FROM (SELECT unnest(range(0, {1 << n})) AS i)"
_nk = problems.NK(10, 3, seed=1)
_states = [" + ".join(f"{_bit(10, j)} * {1 << (3 - pos)}" for pos, j in enumerate(places)) for places in _nk.linked]
_add("nk_landscape", "config:s fitness:d", lambda spark, sf: problems.NK(10, 3, seed=1).get_data(spark), _cube(10, "(" + " + ".join(f"list_extract({[float(v) for v in values]!r}, {state} + 1)" for values, state in zip(_nk.values, _states)) + ") / 10"))
_sat = problems.Max3Sat(9, 3.0, seed=2)
_clauses = " + ".join("(" + " OR ".join(f"{_bit(9, v)} = {int(x)}" for v, x in clause) + ")::INT" for clause in sorted(_sat.clauses))
_add("max3sat_landscape", "config:s fitness:d", lambda spark, sf: problems.Max3Sat(9, 3.0, seed=2).get_data(spark), _cube(9, _clauses))
_parts = problems.NumberPartitioning(9, 1.0, seed=4)
_add("partitioning_landscape", "config:s fitness:d", lambda spark, sf: problems.NumberPartitioning(9, 1.0, seed=4).get_data(spark), _cube(9, "-abs(" + " + ".join(f"(1 - 2 * {_bit(9, j)}) * {x}" for j, x in enumerate(_parts.numbers)) + ")"))
_drawn = lambda p: ", ".join(map(repr, p.draws()))
_mount = problems.RoughMountFuji(9, 0.5, seed=6)
_add("rough_mount_fuji_landscape", "config:s fitness:d", lambda spark, sf: problems.RoughMountFuji(9, 0.5, seed=6).get_data(spark), _cube(9, "0.5 * (" + " + ".join(f"{s!r} * {_bit(9, j)}" for j, s in enumerate(_mount.slope)) + f") + 0.5 * list_extract([{_drawn(_mount)}], i + 1)"))
_add("house_of_cards_landscape", "config:s fitness:d", lambda spark, sf: problems.HoC(8, seed=7).get_data(spark), _cube(8, f"list_extract([{_drawn(problems.HoC(8, seed=7))}], i + 1)"))

# beyond the landscapes of whole tables: epsilon, isolated nodes, sequences, exits, network measures

_e4 = Sql("l4", epsilon=2.0)
_eps4 = lambda spark, sf: landscape(spark, sf, "l4", epsilon=2.0)
_far = {"best": "SELECT root, max(f) AS best FROM plat JOIN enc USING (id) GROUP BY 1", "out": "SELECT p.root, e.src, e.dst, x.f - b.best AS gain FROM edges e JOIN plat p ON p.id = e.src JOIN plat q ON q.id = e.dst JOIN enc x ON x.id = e.dst JOIN best b ON b.root = p.root WHERE p.root <> q.root AND p.size > 1 AND x.f - b.best > 2.0", "lo_e": "SELECT p.id, p.root, p.size, CASE WHEN p.size > 1 THEN p.root NOT IN (SELECT root FROM out) ELSE d.outd = 0 END AS is_lo FROM plat p JOIN deg d ON d.id = p.id"}
_add("plateaus_eps_l4", "node_id:l plateau_id:l plateau_size:l", lambda spark, sf: _eps4(spark, sf).plateaus, _e4.query("SELECT id AS node_id, CASE WHEN size > 1 THEN dense_rank() OVER (ORDER BY CASE WHEN size > 1 THEN root END NULLS LAST) - 1 ELSE -1 END AS plateau_id, size AS plateau_size FROM plat"))
_add("exits_eps_l4", "member:l to:l", lambda spark, sf: _eps4(spark, sf).exits, _e4.query('SELECT src AS member, dst AS "to" FROM out', _far))
_add("local_optima_eps_l4", "node_id:l is_lo:b peak:l", lambda spark, sf: _eps4(spark, sf).optima, _e4.query("SELECT id AS node_id, is_lo, root AS peak FROM lo_e", _far))
for by, pick in (("first", "(src, dst)"), ("best", "(-gain, src, dst)")):
    _climb = _far | {
        "leave": f"SELECT root, arg_min(dst, {pick}) AS t FROM out GROUP BY 1",
        "onward": "SELECT e.id, coalesce(s.t, CASE WHEN p.size > 1 THEN x.t END) AS t FROM enc e LEFT JOIN succ s ON s.id = e.id JOIN plat p ON p.id = e.id LEFT JOIN leave x ON x.root = p.root",
        "up(start, id, steps)": "SELECT id, id, 0 FROM enc UNION ALL SELECT c.start, n.t, c.steps + 1 FROM up c JOIN onward n ON n.id = c.id WHERE n.t IS NOT NULL",
    }
    _add(f"basins_eps_{by}_l4", "node_id:l basin_index:l steps:l", lambda spark, sf, by=by: _eps4(spark, sf).basins_by(exit_by=f"{by}-improvement"), _e4.query("SELECT start AS node_id, CASE WHEN s.is_lo THEN s.root ELSE arg_max(l.root, c.steps) END AS basin_index, CASE WHEN s.is_lo THEN 0 ELSE max(c.steps) END AS steps FROM up c JOIN lo_e l ON l.id = c.id JOIN lo_e s ON s.id = c.start GROUP BY c.start, s.is_lo, s.root", _climb))
_sparse = "WHERE (discount * 37 + tax * 11 + ascii(l_returnflag) * 5 + ascii(l_linestatus)) % 7 = 0"


def _sparse_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = SOURCES["l1"].frame(spark, sf).where(_sparse[6:])
    kinds = {c: k for c, k, _, _ in SOURCES["l1"].columns}
    alone = build(rows, kinds, keep_isolated=True)
    linked = alone.edges.select(F.col("src").alias("node_id")).union(alone.edges.select("dst")).union(alone.neutral.select("u")).union(alone.neutral.select("v")).distinct()
    return alone.nodes.join(linked, "node_id", "left_anti")


_add("isolated_l1", "l_returnflag:s l_linestatus:s discount:l tax:l fitness:d", _sparse_rows, Sql("l1", where=_sparse).query("SELECT l_returnflag, l_linestatus, discount, tax, f AS fitness FROM enc0 WHERE id NOT IN (SELECT u FROM linked UNION SELECT v FROM linked)"))
for kind, letters, table in (("dna", "ACGT", "orders"), ("protein", "ACDEFGHIKLMNPQRSTVWY", "part")):
    key = {"orders": "o_orderkey", "part": "p_partkey"}[table]
    cost = {"orders": "o_totalprice", "part": "p_retailprice"}[table]
    m, width = len(letters), {"orders": 5, "part": 3}[table]
    code = lambda i, m=m, key=key: f"CAST(floor({key} / {m ** i}) AS BIGINT) % {m}"
    seq = " || ".join(f"substr('{letters}', CAST({code(i)} + 1 AS INT), 1)" for i in range(width))
    made = f"SELECT {seq} AS s, max({cost}) AS f FROM {table} GROUP BY 1"
    near = " + ".join(f"(substr(x.s, {i + 1}, 1) <> substr(y.s, {i + 1}, 1))::INT" for i in range(width))
    holed = " UNION ALL ".join(f"SELECT x.s AS a, y.s AS b, x.f AS fa, y.f AS fb FROM g x JOIN g y ON left(x.s, {i}) = left(y.s, {i}) AND substr(x.s, {i + 2}) = substr(y.s, {i + 2}) AND x.s < y.s" for i in range(width))

    def _sequences(spark: SparkSession, sf: str, kind=kind, table=table, seq=seq, cost=cost) -> DataFrame:
        rows = spark.read.parquet(f"{sf}/{table}.parquet").groupBy(F.expr(seq.replace("BIGINT", "LONG")).alias("s")).agg(F.max(cost).cast("double").alias("fitness"))
        land = build(rows, kind=kind)
        name = F.concat(*[F.col(f"`{c}`") for c in land.columns])
        of = land.nodes.select("node_id", name.alias("s"))
        pairs = land.edges.join(of.select(F.col("node_id").alias("src"), F.col("s").alias("worse")), "src").join(of.select(F.col("node_id").alias("dst"), F.col("s").alias("better")), "dst")
        return pairs.select("worse", "better", "delta_fit")

    _add(f"improving_edges_{kind}_{table}", "worse:s better:s delta_fit:d", _sequences, f"WITH g AS ({made}), h AS ({holed}) SELECT CASE WHEN fa < fb THEN a ELSE b END AS worse, CASE WHEN fa < fb THEN b ELSE a END AS better, abs(fa - fb) AS delta_fit FROM h WHERE fa <> fb")
_lon_access = _lon | {"kept": "SELECT src, dst, w FROM lone WHERE f2 >= f1", "back(k, id)": "SELECT id, id FROM lo WHERE is_lo AND id = root UNION SELECT a.k, e.src FROM back a JOIN kept e ON e.dst = a.id"}
_add("lon_measures_l1", "peak:l accessibility:l out_degree:l in_degree:l", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1).nodes, L["l1"].query("SELECT k AS peak, count(*) AS accessibility, (SELECT count(*) FROM kept WHERE src = k) AS out_degree, (SELECT count(*) FROM kept WHERE dst = k) AS in_degree FROM back GROUP BY k", _lon_access))

# many tied optima, several edits, whole transforms, letters in columns

_tied = lambda name: (lambda spark, sf: landscape(spark, sf, name, keep_isolated=True).dist_to_go)
for n in ("l7", "l8"):
    gap = " + ".join(f"abs(e.a{i} - g.a{i})" if o and SOURCES[n].kind != "boolean" else f"(e.a{i} <> g.a{i})::INT" for i, o in enumerate(L[n].ordinal))
    _add(f"dist_to_go_ties_{n}", "node_id:l dist_go:l", _tied(n), L[n].query(f"SELECT e.id AS node_id, min({gap}) AS dist_go FROM enc0 e, (SELECT * FROM enc0 WHERE f = (SELECT max(f) FROM enc0)) g GROUP BY 1"))
_add("dist_to_go_l5", "node_id:l dist_go:l", _of("l5", lambda x: x.dist_to_go), L["l5"].query("SELECT id AS node_id, d AS dist_go FROM dgo"))
_four_edits = " + ".join(f"(x.a{i} <> y.a{i})::INT" for i in range(24))
_add("hamming4_pairs_l9", "u:l v:l", lambda spark, sf: (lambda x: neighbours.edit_pairs(x.nodes, x.variables, 4))(landscape(spark, sf, "l9", keep_isolated=True)), L["l9"].query(f"SELECT x.id AS u, y.id AS v FROM enc0 x JOIN enc0 y ON x.id < y.id AND {_four_edits} <= 4"))
_number = " + ".join(f"a{i} * {1 << i}" for i in range(10))
_signed = lambda spark, sf: M.walsh_hadamard(landscape(spark, sf, "l6", keep_isolated=True), max_order=10).withColumn("signed_sum", F.col("coefficient") * 1024 / F.pow(F.lit(2.0), F.col("order")))
_add("walsh_full_l6", "order:l positions:s signed_sum:d", _signed, L["l6"].query("SELECT bit_count(m) AS \"order\", coalesce((SELECT string_agg(i, ',' ORDER BY i) FROM unnest(range(1, 11)) t(i) WHERE (m >> (i - 1)) & 1 = 1), '') AS positions, sum(f * (1 - 2 * (bit_count(m & ~x) % 2))) AS signed_sum FROM cells, (SELECT unnest(range(0, 1024)) AS m) GROUP BY m", {"cells": f"SELECT {_number} AS x, f FROM enc0"}))
_add("walsh_states_l4", "positions:s term:s coefficient:d", lambda spark, sf: M.walsh_hadamard(landscape(spark, sf, "l4", keep_isolated=True), max_order=1), L["l4"].query(" UNION ALL ".join(["SELECT '' AS positions, '' AS term, avg(f) AS coefficient FROM enc0", *[f"SELECT '{i + 1}' AS positions, '0_{i + 1}_' || chr(CAST(48 + a{i} AS INT)) AS term, avg(f) - (SELECT avg(f) FROM enc0 WHERE a{i} = 0) AS coefficient FROM enc0 WHERE a{i} > 0 GROUP BY a{i}" for i in range(3)]])))
_letters = [("PQR", 1), ("QST", 3), ("UV", 9)]
_cols = [f"substr('{x}', CAST(CAST(floor(o_orderkey / {d}) AS BIGINT) % {len(x)} AS INT) + 1, 1)" for x, d in _letters]


def _alphabet(spark: SparkSession, sf: str) -> DataFrame:
    """Letters a column, a third of them in one column only."""
    cols = [F.expr(e.replace("BIGINT", "LONG")).alias(f"s{i}") for i, e in enumerate(_cols)]
    land = build(spark.read.parquet(f"{sf}/orders.parquet").groupBy(*cols).agg(F.max("o_totalprice").cast("double").alias("fitness")), kind="sequence")
    return spark.createDataFrame([(land.alphabet, *land.shape)], "alphabet string, n_configs long, n_edges long")


_add("alphabet_orders", "alphabet:s n_configs:l n_edges:l", _alphabet, f"WITH g AS (SELECT {', '.join(f'{e} AS s{i}' for i, e in enumerate(_cols))}, max(o_totalprice) AS f FROM orders GROUP BY ALL) SELECT (SELECT string_agg(s, '' ORDER BY s) FROM (SELECT s0 AS s FROM g UNION SELECT s1 FROM g UNION SELECT s2 FROM g)) AS alphabet, (SELECT count(*) FROM g) AS n_configs, (SELECT count(*) FROM g x JOIN g y ON (x.s0 <> y.s0)::INT + (x.s1 <> y.s1)::INT + (x.s2 <> y.s2)::INT = 1 AND x.f < y.f) AS n_edges")

# ranks, medians and fits of whole tables

_pairs5 = "SELECT d, f, count(*) AS n FROM dgo GROUP BY ALL"
_add("fdc_kendall_l5", _V, _of("l5", M.fdc, method="kendall"), L["l5"].query("SELECT (SELECT sum(sign(x.f - y.f) * x.n * y.n) FROM pf x JOIN pf y ON x.d > y.d) / sqrt((SELECT (pow(sum(n), 2) - sum(n * n)) / 2 FROM (SELECT sum(n) AS n FROM pf GROUP BY d)) * (SELECT (pow(sum(n), 2) - sum(n * n)) / 2 FROM (SELECT sum(n) AS n FROM pf GROUP BY f))) AS value", {"pf": _pairs5}))
_pos5 = "list_extract(['supplier', 'quantity', 'discount', 'tax'], p + 1)"
_add("median_effects_l5", "position:s allele_a:l allele_b:l median_abs_effect:d", _of("l5", M.mutation_effects), L["l5"].query(f"SELECT {_pos5} AS position, a AS allele_a, b AS allele_b, quantile_cont(abs(fu - fv), 0.5) / (SELECT stddev_samp(f) FROM enc) AS median_abs_effect FROM pairs GROUP BY ALL"))
_fit = {
    "start": "SELECT quantile_cont(f, 0.5) AS loc, greatest((quantile_cont(f, 0.75) - quantile_cont(f, 0.25)) / 2, 1e-12) AS scale FROM enc",
    "rounds(k, loc, scale)": "SELECT 0, loc, scale FROM start UNION ALL SELECT any_value(r.k) + 1, sum(f / (1 + pow((f - r.loc) / r.scale, 2))) / sum(1 / (1 + pow((f - r.loc) / r.scale, 2))), greatest(any_value(r.scale) * sqrt(2 - 2 * sum(1 / (1 + pow((f - r.loc) / r.scale, 2))) / count(*)), 1e-12) FROM rounds r, enc GROUP BY r.k HAVING any_value(r.k) < 400",
}
for n in ("l1", "l5"):
    _add(f"cauchy_{n}", _V, lambda spark, sf, n=n: spark.createDataFrame([(stats.cauchy_location(landscape(spark, sf, n).nodes),)], "value double"), L[n].query("SELECT loc AS value FROM rounds WHERE k = 400", _fit))

for n in ("l1", "l5"):
    _add(f"fitness_density_{n}", "point:l scaled:d", lambda spark, sf, n=n: plots.fitness_density(landscape(spark, sf, n)).withColumn("scaled", F.col("density") * 1e6), L[n].query("SELECT i AS point, 1e6 * sum(exp(-pow((f - (low + (high - low) * i / 199)) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())) AS scaled FROM enc, (SELECT min(f) AS low, max(f) AS high, count(*) AS n, stddev_samp(f) * pow(count(*), -0.2) AS h FROM enc), (SELECT unnest(range(0, 200)) AS i) GROUP BY i"))

# wedges: an exact count, and shares estimated from some

_add("wedges_l5", "wedges:l", lambda spark, sf: spark.createDataFrame([(M.found_wedges(landscape(spark, sf, "l5")).total,)], "wedges long"), L["l5"].query("SELECT count(*) AS wedges FROM links x JOIN links y ON x.u = y.u AND x.p < y.p"))
_add("epistasis_estimate_l5", "magnitude:d magnitude_error:d sign:d sign_error:d reciprocal_sign:d reciprocal_sign_error:d positive:d negative:d positive_error:d squares:l wedges:l", _of("l5", M.estimate_epistasis, samples=20_000, seed=1))

# ranks: residuals are pushed along the edges, and their sum is brought to 1

_pushed = {
    "sh": "SELECT src, dst, d / sum(d) OVER (PARTITION BY src) AS share FROM edges",
    "push(k, id, r)": "SELECT 0, id, CAST(1 AS DOUBLE) FROM enc UNION ALL SELECT any_value(p.k) + 1, dst, 0.85 * sum(r * share) FROM push p JOIN sh ON src = id GROUP BY p.k, dst HAVING any_value(p.k) < 300",
}
for n in ("l3", "l5"):
    scale = {"l3": "", "l5": " * 1000"}[n]
    _add(f"pagerank_{n}", "node_id:l pagerank:d", lambda spark, sf, n=n: (lambda x: x.withColumn("pagerank", F.col("pagerank") * 1000) if n == "l5" else x)(landscape(spark, sf, n).pagerank), L[n].query(f"SELECT id AS node_id, sum(r) / (SELECT sum(r) FROM push){scale} AS pagerank FROM push GROUP BY id", _pushed))
_lon_push = _lon_access | {
    "tops": "SELECT id FROM lo WHERE is_lo AND id = root",
    "lsh": "SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM kept",
    "lpush(k, id, r)": "SELECT 0, id, CAST(1 AS DOUBLE) FROM tops UNION ALL SELECT any_value(p.k) + 1, dst, 0.85 * sum(r * share) FROM lpush p JOIN lsh ON src = id GROUP BY p.k, dst HAVING any_value(p.k) < 300",
}
_add("lon_pagerank_l1", "peak:l pagerank:d", lambda spark, sf: landscape(spark, sf, "l1").get_lon(min_edge_freq=1).nodes, L["l1"].query("SELECT id AS peak, sum(r) / (SELECT sum(r) FROM lpush) AS pagerank FROM lpush GROUP BY id", _lon_push))

# GraphML written and read back by executors


def _back(spark: SparkSession, sf: str) -> DataFrame:
    land = store.from_graphml(spark, store.write_graphml(_eps4(spark, sf), fresh(spark, "graphml")))
    return land.plateaus.join(land.degrees, "node_id").join(land.nodes, "node_id")


_add("graphml_l4", "node_id:l event_type:s hour:l day:l fitness:d plateau_id:l plateau_size:l in_degree:l out_degree:l", _back, _e4.query("SELECT e.id AS node_id, event_type, hour, day, f AS fitness, CASE WHEN size > 1 THEN dense_rank() OVER (ORDER BY CASE WHEN size > 1 THEN root END NULLS LAST) - 1 ELSE -1 END AS plateau_id, size AS plateau_size, ind AS in_degree, outd AS out_degree FROM enc e JOIN plat p ON p.id = e.id JOIN deg g ON g.id = e.id"))

# a kind of input of one's own: sequences read as pairs of letters


def _pairs_of_letters(batch):
    import pyarrow as pa
    import pyarrow.compute as pc

    s = batch.column(0)
    return pa.RecordBatch.from_arrays([pc.utf8_slice_codeunits(s, 0, 2), pc.utf8_slice_codeunits(s, 2, 4), pc.cast(pc.count_substring_regex(s, "[CG]"), pa.int32())], names=["first", "second", "gc"])


_seq4 = {k: " || ".join(f"substr('ACGT', CAST(CAST(floor(o_orderkey / {4 ** i}) AS {k}) % 4 AS INT) + 1, 1)" for i in range(4)) for k in ("LONG", "BIGINT")}


def _handled(spark: SparkSession, sf: str) -> DataFrame:
    known = Handlers()
    known.register("pairs of letters", InputHandler(_pairs_of_letters, {"first": "categorical", "second": "categorical", "gc": "ordinal"}, {"first": "string", "second": "string"}))
    rows = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.expr(_seq4["LONG"]).alias("s")).agg(F.max("o_totalprice").cast("double").alias("fitness"))
    land = build(rows, kind="pairs of letters", handlers=known, neighbours_by="hamming", keep_isolated=True)
    of = land.nodes.select("node_id", F.concat("first", "second").alias("s"), "gc")
    return land.edges.join(of.select(F.col("node_id").alias("src"), F.col("s").alias("worse"), "gc"), "src").join(of.select(F.col("node_id").alias("dst"), F.col("s").alias("better")), "dst")


_gc = "length(replace(replace(s, 'A', ''), 'T', ''))"
_add("handled_orders", "worse:s better:s gc:l delta_fit:d", _handled, f"WITH g AS (SELECT s, f, left(s, 2) AS a, right(s, 2) AS b, {_gc} AS gc FROM (SELECT {_seq4['BIGINT']} AS s, max(o_totalprice) AS f FROM orders GROUP BY 1)) SELECT x.s AS worse, y.s AS better, x.gc, y.f - x.f AS delta_fit FROM g x JOIN g y ON (x.a <> y.a)::INT + (x.b <> y.b)::INT + (x.gc <> y.gc)::INT = 1 AND x.f < y.f")

# loops on a landscape too large for the driver's side

_add("basins_l5", "node_id:l basin_index:l steps:l", _of("l5", lambda x: x.basins), L["l5"].query("SELECT id AS node_id, b AS basin_index, steps FROM basin"))
_add("local_optima_l5", "node_id:l is_lo:b peak:l", _of("l5", lambda x: x.optima), L["l5"].query("SELECT id AS node_id, is_lo, root AS peak FROM lo"))
_add("path_length_l5", "mean:d variance:d", _of("l5", M.mean_path_length_to_global_optimum), L["l5"].query("SELECT avg(d) AS mean, var_pop(d) AS variance FROM godist"))

# without an SQL form: iterations to a limit, seeded walks, the whole profile

_add("autocorrelation_l3", _V, _of("l3", M.autocorrelation))
_add("missing_report_part", "column:s nulls:l", lambda spark, sf: spark.createDataFrame(sorted(ingest.missing_report(spark.read.parquet(f"{sf}/part.parquet")).items()), "column string, nulls long"), "SELECT * FROM (UNPIVOT (SELECT count(*) - count(COLUMNS(*)) FROM part) ON COLUMNS(*) INTO NAME \"column\" VALUE nulls)")
QUERIES["profile_l3"] = lambda spark, sf: profile(landscape(spark, sf, "l3"))
QUERIES["list_metrics"] = lambda spark, sf: list_metrics(spark)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local optima of the lineitem landscape with their configurations."""
    land = landscape(spark, sf_dir, "l1")
    return land.nodes.join(land.optima, "node_id").select("node_id", *L["l1"].names, "fitness", "is_lo")


_add("landscape_slice_l1", "node_id:l l_returnflag:s l_linestatus:s discount:l tax:l fitness:d is_lo:b", flagship, L["l1"].query("SELECT e.id AS node_id, l_returnflag, l_linestatus, discount, tax, f AS fitness, is_lo FROM enc e JOIN lo ON lo.id = e.id"))
