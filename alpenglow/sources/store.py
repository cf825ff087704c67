"""Saving and loading landscapes: Parquet tables with a JSON of settings, and GraphML.

:func:`write_graphml` and :func:`from_graphml` work on executors: a document is a folder of parts, which
in the order of their names are one GraphML file, and parts or whole files are read by their elements.
"""

from __future__ import annotations

import json
from dataclasses import asdict
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.errors import DataError
from alpenglow.operators import neighbours
from alpenglow.plans.cut import written
from alpenglow.plans.landscape import Landscape
from alpenglow.sources.ingest import Variable


def save(land: Landscape, path: str) -> None:
    """Tables ``nodes``, ``edges``, ``neutral`` and ``meta`` (one JSON row) below ``path``."""
    for name in ("nodes", "edges", "neutral"):
        getattr(land, name).write.mode("overwrite").parquet(f"{path}/{name}")
    meta = {"maximize": land.maximize, "epsilon": land.epsilon, "kind": land.kind, "alphabet": land.alphabet, "n_edit": land.n_edit, "typed": land.typed, "n_configs": land.n_configs, "columns": land.columns, "variables": [asdict(v) for v in land.variables]}
    land.spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load(spark: SparkSession, path: str) -> Landscape:
    """A saved landscape; derived tables are computed anew when asked for."""
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    land = Landscape(meta.get("maximize", True), meta["epsilon"])
    land.kind, land.alphabet, land.n_edit, land.typed, land.columns = (meta[k] for k in ("kind", "alphabet", "n_edit", "typed", "columns"))
    land.variables = [Variable(**v) for v in meta["variables"]]
    land.n_configs = meta["n_configs"]
    land.nodes, land.edges, land.neutral = (spark.read.parquet(f"{path}/{name}") for name in ("nodes", "edges", "neutral"))
    land.built = True
    return land


def to_graphml(land: Landscape, path: str) -> str:
    """One GraphML file on the driver, streamed row by row; ``.graphml`` is added if missing. For graphs small enough to draw."""
    path = path if path.endswith(".graphml") else f"{path}.graphml"
    data = land.get_data()
    with open(path, "w") as out:
        out.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n')
        kinds = {"double": "double", "bigint": "long", "int": "int", "boolean": "boolean"}
        for c, k in data.dtypes:
            if c != "node_id":
                out.write(f'<key id="v_{escape(c)}" for="node" attr.name="{escape(c)}" attr.type="{kinds.get(k, "string")}"/>\n')
        out.write('<key id="e_delta_fit" for="edge" attr.name="delta_fit" attr.type="double"/>\n')
        for name, value in {**land.get_params(), "kind": land.kind, "variables": json.dumps([asdict(v) for v in land.variables])}.items():
            out.write(f'<key id="g_{name}" for="graph" attr.name="{name}" attr.type="string"><default>{escape(str(value))}</default></key>\n')
        out.write('<graph edgedefault="directed">\n')
        for r in data.toLocalIterator():
            cells = "".join(f'<data key="v_{escape(c)}">{escape(str(r[c]))}</data>' for c in data.columns if c != "node_id" and r[c] is not None)
            out.write(f'<node id="n{r["node_id"]}">{cells}</node>\n')
        for r in land.edges.toLocalIterator():
            out.write(f'<edge source="n{r["src"]}" target="n{r["dst"]}"><data key="e_delta_fit">{r["delta_fit"]!r}</data></edge>\n')
        out.write("</graph>\n</graphml>\n")
    return path


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The node table of a GraphML file with its columns typed, and the graph's settings; build a landscape from it."""
    import xml.etree.ElementTree as ET

    ns = "{http://graphml.graphdrawing.org/xmlns}"
    keys, settings, rows = {}, {}, []
    cast = {"double": float, "float": float, "long": int, "int": int, "boolean": lambda s: s.lower() == "true"}
    for _, e in ET.iterparse(path):
        tag = e.tag.removeprefix(ns)
        if tag == "key":
            keys[e.get("id")] = (e.get("attr.name"), cast.get(e.get("attr.type"), str))
            if e.get("for") == "graph" and (d := e.find(f"{ns}default")) is not None:
                settings[e.get("attr.name")] = d.text
        elif tag == "node":
            row = {"ordinal": len(rows)}
            for d in e.findall(f"{ns}data"):
                name, kind = keys[d.get("key")]
                row[name] = kind(d.text)
            rows.append(row)
            e.clear()
    names = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(k) for k in names) for r in rows], names), settings


#: Types of Spark's columns in GraphML, and back.
TYPES = {"double": "double", "float": "float", "bigint": "long", "int": "int", "boolean": "boolean"}
BACK = {"double": "double", "float": "double", "long": "bigint", "int": "int", "boolean": "boolean"}


def _escaped(c: Column) -> Column:
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(plain), F.lit(safe))
    return c


def _data(key: str, value: Column) -> Column:
    text = F.concat(F.lit(f'<data key="{key}">'), _escaped(value.cast("string")), F.lit("</data>"))
    return F.coalesce(text, F.lit(""))


def write_graphml(land: Landscape, path: str) -> str:
    """The landscape as GraphML in the folder ``path``, written by partitions: a head, nodes, edges and a tail, in the order of the parts' names.

    Nodes carry their data, codes and plateaus, edges their gain; the settings are defaults of graph keys.
    Characters that XML has no form for are the user's to avoid.
    """
    spark, plateau = land.spark, land.plateaus
    nodes = land.nodes.join(plateau, "node_id").withColumn("cfg", F.array_join(F.transform("cfg", lambda x: x.cast("string")), ","))
    head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">']
    columns = [(f"v{i}", c, k) for i, (c, k) in enumerate(nodes.dtypes) if c != "node_id"]
    head += [f'<key id="{key}" for="node" attr.name="{escape(c)}" attr.type="{TYPES.get(k, "string")}"/>' for key, c, k in columns]
    head.append('<key id="e0" for="edge" attr.name="delta_fit" attr.type="double"/>')
    settings = land.get_params() | {"kind": land.kind, "n_edit": land.n_edit, "typed": land.typed, "alphabet": land.alphabet, "columns": land.columns, "variables": [asdict(v) for v in land.variables], "n_configs": land.n_configs}
    head += [f'<key id="g_{name}" for="graph" attr.name="{name}" attr.type="string"><default>{escape(json.dumps(value))}</default></key>' for name, value in settings.items()]
    one = lambda lines: spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1)
    body = nodes.select(F.concat(F.lit('<node id="n'), F.col("node_id").cast("string"), F.lit('">'), *[_data(key, F.col(f"`{c}`")) for key, c, _ in columns], F.lit("</node>")).alias("value"))
    links = land.edges.select(F.concat(F.lit('<edge source="n'), F.col("src").cast("string"), F.lit('" target="n'), F.col("dst").cast("string"), F.lit('">'), _data("e0", F.col("delta_fit")), F.lit("</edge>")).alias("value"))
    # a union keeps the order of its sides' partitions, and parts are named in that order
    whole = one([*head, '<graph edgedefault="directed">']).union(body).union(links).union(one(["</graph>", "</graphml>"]))
    whole.write.mode("overwrite").text(path)
    return path


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    # by row tags alone: a part of a document has no root, which Spark's stricter parser needs
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("useLegacyXMLParser", True).schema(schema).load(path)


def from_graphml(spark: SparkSession, path: str) -> Landscape:
    """A landscape from GraphML: a folder of :func:`write_graphml`, or a file that others wrote.

    Nodes, edges and plateaus are read back, not found anew; neutral pairs follow from the codes when asked
    for. Where a file has no settings they are inferred: the direction of search from the edges, a column's
    kind from its values (0 and 1: boolean, other whole numbers: ordinal, else categorical), and codes from the levels.
    A file without nodes or without fitness is an error.
    """
    found = _elements(spark, path, "key", "_id string, _for string, `_attr.name` string, `_attr.type` string, default string").collect()  # a row a column
    settings = {k["_attr.name"]: k["default"] for k in found if k["_for"] == "graph" and k["default"] is not None}
    known = {k: json.loads(v) for k, v in settings.items()} if "variables" in settings else {}
    data = "data array<struct<_key: string, _VALUE: string>>"
    at = lambda key: F.get(F.filter("data", lambda d: d["_key"] == key), F.lit(0))["_VALUE"]
    id_of = lambda c: F.regexp_extract(F.col(c), r"(\d+)$", 1).cast("long")
    keys = [(k["_id"], k["_attr.name"], BACK.get(k["_attr.type"], "string")) for k in found if k["_for"] == "node"]
    if "fitness" not in {c for _, c, _ in keys}:
        raise DataError("nodes have no fitness")
    rows = _elements(spark, path, "node", f"_id string, {data}").select(id_of("_id").alias("node_id"), *[at(key).cast(t).alias(c) for key, c, t in keys])
    rows = written(rows, "graphml-nodes")
    e_keys = [k["_id"] for k in found if k["_for"] == "edge" and k["_attr.name"] == "delta_fit"]
    edges = _elements(spark, path, "edge", f"_source string, _target string, {data}").select(id_of("_source").alias("src"), id_of("_target").alias("dst"), (at(e_keys[0]).cast("double") if e_keys else F.lit(None).cast("double")).alias("delta_fit"))
    if not e_keys:
        f = rows.select("node_id", "fitness")
        edges = edges.drop("delta_fit").join(f.toDF("src", "f1"), "src").join(f.toDF("dst", "f2"), "dst").select("src", "dst", F.abs(F.col("f1") - F.col("f2")).alias("delta_fit"))
    edges = written(edges, "graphml-edges")
    if not rows.limit(1).count():
        raise DataError("no nodes")
    land = Landscape(known["maximize"] if known else _upwards(rows, edges), known.get("epsilon", 0.0))
    if known:
        land.kind, land.alphabet, land.n_edit, land.typed, land.columns, land.n_configs = (known[k] for k in ("kind", "alphabet", "n_edit", "typed", "columns", "n_configs"))
        land.variables = [Variable(**v) for v in known["variables"]]
        rows = rows.withColumn("cfg", F.split("cfg", ",").cast("array<int>"))
    else:
        rows = _inferred(land, rows)
    land.nodes, land.edges = rows.select("node_id", "cfg", "fitness", *[F.col(f"`{c}`") for c in land.columns]), edges
    pairs = neighbours.edit_pairs(land.nodes, land.variables, land.n_edit) if land.n_edit > 1 else neighbours.hamming_pairs(land.nodes, land.variables, land.typed)
    _, land.neutral = neighbours.classify(pairs, land.epsilon, land.maximize)
    if {"plateau_id", "plateau_size", "peak"} <= set(rows.columns):
        land.__dict__["plateaus"] = rows.select("node_id", "plateau_id", "plateau_size", "peak")
    land.built = True
    return land


def _upwards(rows: DataFrame, edges: DataFrame) -> bool:
    """Whether edges lead to greater fitness; also where there are none."""
    f = rows.select("node_id", "fitness")
    gain = edges.join(f.toDF("src", "f1"), "src").join(f.toDF("dst", "f2"), "dst").agg(F.sum(F.signum(F.col("f2") - F.col("f1")))).first()[0]
    return gain is None or gain >= 0


def _inferred(land: Landscape, rows: DataFrame) -> DataFrame:
    """Sets what the landscape's variables look like, and gives its rows their codes."""
    derived = {"node_id", "fitness", "is_lo", "peak", "plateau_id", "plateau_size", "in_degree", "out_degree", "basin_index", "pagerank", "cfg"}
    land.columns = [c for c in rows.columns if c not in derived]
    sets = rows.agg(*[F.array_sort(F.collect_set(F.col(f"`{c}`"))).alias(f"s{i}") for i, c in enumerate(land.columns)], F.count(F.lit(1)).alias("n")).first()
    codes, types = [], dict(rows.dtypes)
    for i, c in enumerate(land.columns):
        levels = list(sets[f"s{i}"])
        if len(levels) > 1:
            whole = types[c] in ("int", "bigint")
            kind = "boolean" if levels in ([0, 1], [False, True]) else "ordinal" if whole else "categorical"
            land.variables.append(Variable(c, kind, len(levels)))
            codes.append((F.array_position(F.array(*[F.lit(x) for x in levels]).cast(f"array<{types[c]}>"), F.col(f"`{c}`")) - 1).cast("int"))
    if not codes:
        raise DataError("every variable has one value only")
    land.n_configs = sets["n"]
    land.typed = any(v.kind == "ordinal" for v in land.variables)
    return rows.withColumn("cfg", F.array(*codes))
