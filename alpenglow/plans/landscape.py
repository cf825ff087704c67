"""The landscape: encoded nodes, and everything derived from them as lazily computed tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import cached_property
from threading import RLock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.errors import DataError, NotBuiltError, ParameterError
from alpenglow.functions.numbering import SMALL, numbered
from alpenglow.operators import bitreach, local, neighbours, structure
from alpenglow.operators.components import components
from alpenglow.operators.graph import pagerank
from alpenglow.operators.nearest import nearest
from alpenglow.plans.cut import written
from alpenglow.sources import ingest
from alpenglow.sources.handlers import Handlers
from alpenglow.sources.ingest import ALPHABETS, Encoded, Variable

log = logging.getLogger("alpenglow")


class kept(cached_property):
    """A derived table, made once, also if several threads ask for it."""

    def __get__(self, instance, owner=None):
        if instance is None:
            return self
        with instance.lock:
            return super().__get__(instance, owner)


class Landscape:
    """Configurations as nodes, improving neighbours as edges, equal neighbours as neutral pairs.

    Built by :func:`build` and the constructors below; a built landscape doesn't change. All tables
    are cut from their lineage when first asked for, and shared by the metrics.
    """

    def __init__(self, maximize: bool = True, epsilon: float = 0.0):
        if epsilon < 0:
            raise ParameterError("epsilon must not be negative")
        self.maximize, self.epsilon = maximize, float(epsilon)
        self.built = False
        self.lock = RLock()
        self.kind, self.alphabet, self.n_edit = "default", None, 1
        self.variables: list[Variable] = []
        self.columns: list[str] = []
        self.typed, self.n_configs = False, 0

    # building

    def _build(
        self, encoded: Encoded, n_edit: int = 1, neighbours_by: str = "typed", generate: Callable | None = None,
        tau: float | None = None, keep_isolated: bool = False,
    ) -> Landscape:
        if self.built:
            raise RuntimeError("this landscape is built already")
        if n_edit < 1:
            raise ParameterError("n_edit must be 1 or more")
        if neighbours_by not in ("typed", "hamming"):
            raise ParameterError("neighbours are 'typed' or 'hamming'")
        self.kind, self.alphabet, self.variables, self.columns, self.n_edit = encoded.kind, encoded.alphabet, encoded.variables, encoded.columns, n_edit
        self.typed = neighbours_by == "typed" and any(v.kind == "ordinal" for v in self.variables)
        if n_edit > 1 and self.typed and generate is None:
            raise ParameterError("typed neighbours are one edit apart; use neighbours_by='hamming' for more")
        nodes = encoded.nodes
        if generate is not None:
            pairs = neighbours.generated_pairs(nodes, generate)
        elif n_edit > 1:
            pairs = neighbours.edit_pairs(nodes, self.variables, n_edit)
        else:
            pairs = neighbours.hamming_pairs(nodes, self.variables, self.typed)
        pairs = written(pairs.select("u", "v", "fu", "fv"), "pairs")
        n = encoded.n
        if tau is not None:
            nodes, pairs, n = self._above(nodes, pairs, tau, n)
        if not keep_isolated:
            nodes, pairs, n = self._linked(nodes, pairs, n)
        self.nodes, self.n_configs = nodes, n
        # narrow reads of one table; the wide joins are behind it
        self.edges, self.neutral = neighbours.classify(pairs, self.epsilon, self.maximize)
        self.built = True
        return self

    def _above(self, nodes: DataFrame, pairs: DataFrame, tau: float, n: int) -> tuple[DataFrame, DataFrame, int]:
        """Without edges both of whose ends are worse than tau; of the rest the largest weakly connected component (first of equals)."""
        worse = (lambda c: F.col(c) < tau) if self.maximize else (lambda c: F.col(c) > tau)
        neutral = F.abs(F.col("fu") - F.col("fv")) <= neighbours.neutral_bound(self.epsilon)
        pairs = written(pairs.where(neutral | ~(worse("fu") & worse("fv"))), "pairs")
        found = components(pairs.where(~neutral), "u", "v", local.LIMIT)
        rooted = nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("root", "node_id").alias("root"))
        best = rooted.groupBy("root").count().orderBy(F.desc("count"), "root").limit(1)
        kept = written(rooted.join(F.broadcast(best.select("root")), "root").select("node_id"), "kept")  # best: one row
        return self._only(nodes, pairs, kept, kept.count())

    def _linked(self, nodes: DataFrame, pairs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        """Without nodes that are in no pair."""
        kept = written(pairs.select("u").union(pairs.select("v")).toDF("node_id").distinct(), "kept")
        n_kept = kept.count()
        if not n_kept:
            raise DataError("no two configurations are neighbours")
        if n_kept == n:
            return nodes, pairs, n
        log.warning("%d configurations without neighbours are left out", n - n_kept)
        return self._only(nodes, pairs, kept, n_kept)

    @staticmethod
    def _only(nodes: DataFrame, pairs: DataFrame, kept: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
        """The kept nodes, numbered anew in their order, and the pairs between them."""
        new = written(numbered(kept.withColumnRenamed("node_id", "old"), ["old"], small=n <= SMALL), "new-ids")
        nodes = written(nodes.withColumnRenamed("node_id", "old").join(new, "old").select("node_id", *[c for c in nodes.columns if c != "node_id"]), "nodes")
        for c in ("u", "v"):
            pairs = pairs.withColumnRenamed(c, "old").join(new, "old").drop("old").withColumnRenamed("node_id", c)
        return nodes, written(pairs.select("u", "v", "fu", "fv"), "pairs"), n

    # derived tables

    def _need(self) -> None:
        if not self.built:
            raise NotBuiltError("the landscape is not built yet")

    def __getattr__(self, name: str):
        if name in ("nodes", "edges", "neutral"):
            raise NotBuiltError("the landscape is not built yet")
        raise AttributeError(name)

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @kept
    def n_edges(self) -> int:
        return self.edges.count()

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_configs, self.n_edges

    @property
    def n_vars(self) -> int:
        return len(self.variables)

    @kept
    def hamming(self) -> DataFrame:
        """All pairs at Hamming distance 1, with position and codes, whatever the variables' kinds."""
        return written(neighbours.hamming_pairs(self.nodes, self.variables), "hamming")

    @kept
    def degrees(self) -> DataFrame:
        return written(structure.degrees(self.nodes, self.edges), "degrees")

    @kept
    def has_neutral(self) -> bool:
        return bool(self.neutral.limit(1).count())

    @kept
    def plateaus(self) -> DataFrame:
        if not self.has_neutral:
            one = F.lit(1).cast("long")
            return self.nodes.select("node_id", F.lit(-1).cast("long").alias("plateau_id"), one.alias("plateau_size"), F.col("node_id").alias("peak"))
        return written(structure.plateaus(self.nodes, self.neutral, self.n_configs <= SMALL), "plateaus")

    @kept
    def exits(self) -> DataFrame:
        if not self.has_neutral:
            return self.spark.createDataFrame([], "plateau_id long, member long, to long")
        return written(structure.exits(self.nodes, self.edges, self.plateaus, self.epsilon, self.maximize), "exits")

    @kept
    def optima(self) -> DataFrame:
        """``(node_id, is_lo, peak)`` of every node."""
        return written(structure.local_optima(self.nodes, self.degrees, self.plateaus, self.exits), "optima")

    @kept
    def n_lo(self) -> int:
        """Local optima; a plateau counts once."""
        return self.optima.where("is_lo and node_id = peak").count()

    @kept
    def lo_index(self) -> list[int]:
        return sorted(r[0] for r in self.optima.where("is_lo").select("node_id").collect())

    @kept
    def go_index(self) -> int:
        best = F.max(F.struct("fitness", (-F.col("node_id")).alias("n"))) if self.maximize else F.max(F.struct((-F.col("fitness")).alias("f"), (-F.col("node_id")).alias("n")))
        return int(-self.nodes.agg(best.alias("m")).select("m.n").first()[0])

    @kept
    def pointers(self) -> DataFrame:
        """Climbs without plateau exits."""
        return written(structure.climb_pointers(self.nodes, self.edges), "pointers")

    def basins_by(self, strategy: str = "best-improvement", exit_by: str = "first-improvement", seed: int = 0) -> DataFrame:
        """:attr:`basins` of climbs and exits chosen otherwise (see :func:`alpenglow.operators.structure.climb_pointers`)."""
        pointers = structure.climb_pointers(self.nodes, self.edges, self.plateaus, self.exits, strategy, exit_by, self.maximize, seed)
        return structure.greedy_basins(self.nodes, pointers, self.optima)

    @kept
    def basins(self) -> DataFrame:
        """``(node_id, basin_index, steps)`` of climbs that leave plateaus by their first exit."""
        pointers = structure.climb_pointers(self.nodes, self.edges, self.plateaus, self.exits) if self.has_neutral else self.pointers
        return written(structure.greedy_basins(self.nodes, pointers, self.optima), "basins")

    @kept
    def basin_sizes(self) -> DataFrame:
        return written(structure.basin_sizes(self.basins), "basin-sizes")

    @kept
    def ancestors(self) -> DataFrame:
        """``(peak, node, dist)``: every node that can climb to a peak, in the fewest steps."""
        return structure.accessible(self.edges, self.optima)

    @kept
    def ancestor_counts(self) -> DataFrame:
        """``(key, dist, n)``: how many nodes climb to the peak ``key`` in ``dist`` steps at least; no pair of both is ever a row."""
        seeds = self.optima.where("is_lo").select(F.col("peak").alias("key"), F.col("node_id").alias("node"))
        return written(bitreach.reach_counts(self.edges, seeds, "dst", "src"), "ancestor-counts")

    @kept
    def accessible_paths(self) -> DataFrame:
        """``(node_id, size_basin_accessible)``: nodes that can climb to a peak, itself included; 0 for other nodes."""
        sizes = bitreach.sizes(self.ancestor_counts).select(F.col("key").alias("node_id"), F.col("size").alias("n"))
        return written(self.nodes.select("node_id").join(sizes, "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).cast("long").alias("size_basin_accessible")), "accessible")

    def distance_kind(self) -> str | list[str]:
        if self.kind in ("boolean", "dna", "rna", "protein"):
            return "hamming"
        return [v.kind for v in self.variables]

    @kept
    def dist_to_go(self) -> DataFrame:
        """``(node_id, dist_go)``: distance to the nearest of all best configurations."""
        return self.distances_to_go(self.distance_kind())

    def distances_to_go(self, kind) -> DataFrame:
        """:attr:`dist_to_go` by another distance: a name, a list of them, or a function of two code arrays."""
        best = self.nodes.agg((F.max if self.maximize else F.min)("fitness").alias("fitness"))
        tied = written(self.nodes.join(F.broadcast(best), "fitness").select("node_id", F.col("cfg").alias("go")), "tied")  # best: one row
        others = self.nodes.join(tied.select("node_id"), "node_id", "left_anti")
        near = nearest(others, tied.select(F.col("go").alias("cfg")), kind, self.variables, "dist_go")
        near = near if callable(kind) else near.withColumn("dist_go", F.col("dist_go").cast("long"))
        return written(near.union(tied.select("node_id", F.lit(0).cast(near.schema["dist_go"].dataType))), "dist-go")

    @kept
    def neighbour_fitness(self) -> DataFrame:
        return written(structure.neighbour_fitness(self.nodes, self.edges, self.neutral), "neighbour-fitness")

    @kept
    def edge_gains(self) -> DataFrame:
        """Edges with ``delta_mean_neighbor_fit``: mean neighbour fitness of the target less that of the source."""
        m = self.neighbour_fitness
        a, b = m.select(F.col("node_id").alias("src"), F.col("mean_neighbor_fit").alias("ma")), m.select(F.col("node_id").alias("dst"), F.col("mean_neighbor_fit").alias("mb"))
        return written(self.edges.join(a, "src").join(b, "dst").select("src", "dst", "delta_fit", (F.col("mb") - F.col("ma")).alias("delta_mean_neighbor_fit")), "edge-gains")

    @kept
    def pagerank(self) -> DataFrame:
        return written(pagerank(self.nodes, self.edges), "pagerank")

    # reading

    def get_data(self, lo_only: bool = False, include_pagerank: bool = False, network=None) -> DataFrame:
        """The node table with its derived columns; ``lo_only``: local optima with those of their basins.

        A ``network`` of :meth:`get_lon` gives these the measures of their peak in it, as columns ``lon_*``.
        """
        rows = self.nodes.select("node_id", *[F.col(f"`{c}`") for c in self.columns], "fitness").join(self.optima.select("node_id", "is_lo", "peak"), "node_id")
        if self.has_neutral:
            rows = rows.join(self.plateaus.select("node_id", "plateau_id", "plateau_size"), "node_id")
        if include_pagerank:
            rows = rows.join(self.pagerank, "node_id")
        if not lo_only:
            return rows.drop("peak").join(self.degrees, "node_id").join(self.basins.select("node_id", "basin_index"), "node_id").orderBy("node_id")
        sizes = self.basin_sizes.join(self.accessible_paths, "node_id").withColumnRenamed("node_id", "peak")
        rows = rows.where("is_lo").drop("is_lo").join(sizes, "peak")
        if network is not None:
            measures = ("escape_difficulty", "improve_rate", "accessibility", "in_degree", "out_degree")
            rows = rows.join(network.nodes.select("peak", *[F.col(c).alias(f"lon_{c}") for c in measures]), "peak", "left")
        return rows.drop("peak").orderBy("node_id")

    def get_lon(self, **options):
        """The local optima network (see :mod:`alpenglow.operators.lon`)."""
        from alpenglow.operators.lon import local_optima_network

        return local_optima_network(self, **options)

    def describe(self) -> dict:
        """Sizes and settings."""
        self._need()
        return {
            "kind": self.kind, "maximize": self.maximize, "epsilon": self.epsilon, "n_edit": self.n_edit, "n_vars": self.n_vars, "n_configs": self.n_configs, "n_edges": self.n_edges,
            "n_neutral_pairs": self.neutral.count(), "n_lo": self.n_lo, "go_index": self.go_index,
            "n_plateaus": self.plateaus.where("plateau_id >= 0").select("plateau_id").distinct().count(),
        }

    def get_params(self) -> dict:
        return {"maximize": self.maximize, "epsilon": self.epsilon}

    def __len__(self) -> int:
        return self.n_configs if self.built else 0

    def __bool__(self) -> bool:
        return self.built

    def __contains__(self, node_id: int) -> bool:
        return 0 <= node_id < self.n_configs

    def __getitem__(self, node_id: int) -> dict:
        row = self.nodes.where(F.col("node_id") == node_id).first()
        if row is None:
            raise KeyError(node_id)
        return row.asDict()

    def __iter__(self):
        return (r[0] for r in self.nodes.select("node_id").orderBy("node_id").toLocalIterator())

    def __repr__(self) -> str:
        return f"Landscape(kind={self.kind!r}, built={self.built}, maximize={self.maximize}, epsilon={self.epsilon})"


#: Columns that a landscape's tables add; a variable of such a name gets an underscore.
RESERVED = {
    "node_id", "cfg", "fitness", "ordinal", "is_lo", "peak", "plateau_id", "plateau_size", "in_degree", "out_degree", "basin_index", "pagerank", "size_basin_greedy",
    "radius_basin_greedy", "size_basin_accessible", "old", "_first",
}


def _apart(df: DataFrame, kinds: dict[str, str] | None, levels: dict[str, list] | None, fitness: str, ordinal: str | None):
    """Variables renamed until none is called like a column of a landscape, and the new names."""
    rename: dict[str, str] = {}
    for c in df.columns:
        if c in (fitness, ordinal) or (kinds and c not in kinds):
            continue
        new, taken = c, {x.lower() for x in df.columns if x != c} | {x.lower() for x in rename.values()}
        while new.lower() in RESERVED or new.lower() in taken:
            new += "_"
        if new != c:
            rename[c] = new
    if not rename:
        return df, kinds, levels
    to = lambda given: given and {rename.get(c, c): v for c, v in given.items()}
    return df.withColumnsRenamed(rename), to(kinds), to(levels)


def build(
    df: DataFrame, kinds: dict[str, str] | None = None, *, kind: str = "default", fitness: str = "fitness", maximize: bool = True, epsilon: float = 0.0,
    tau: float | None = None, filter_mode: str = "any", n_edit: int = 1, neighbours_by: str = "typed", ordinal: str | None = None, alphabet: str | None = None,
    generate: Callable | None = None, levels: dict[str, list] | None = None, rules=None, keep_isolated: bool = False, handlers: Handlers | None = None,
) -> Landscape:
    """A landscape from a table of variables and a fitness column.

    ``kind`` is boolean, ordinal, categorical, dna, rna, protein, sequence (with ``alphabet``, or
    inferred) or default, which needs ``kinds`` of all columns. ``tau`` keeps good rows before
    building (filter_mode ``any``), or after it drops edges between bad ones (``both``). A variable called
    like a column that landscapes have (node_id, cfg, ...) gets an underscore after its name. ``rules``
    is a :class:`alpenglow.plans.filters.RowFilter`. ``generate`` gives a configuration's
    neighbours by a rule of one's own: those of one tuple of codes, or, if its attribute ``batches`` is
    true, of a matrix of them at once, as (row of the matrix, codes) arrays. ``handlers`` parse kinds of
    input of one's own.
    """
    if filter_mode not in ("any", "both"):
        raise ParameterError("filter_mode is 'any' or 'both'")
    out = Landscape(maximize, epsilon)
    if rules is not None:
        df = rules.apply(df)
    if tau is not None and filter_mode == "any":
        df = ingest.tau_filter(df, tau, maximize, fitness)
        if not df.limit(1).count():
            raise DataError("no row is as good as tau")
    if handlers is not None and kind in handlers:
        df, kinds = handlers[kind].apply(df, fitness, ordinal)
        df, kinds, levels = _apart(df, kinds, levels, fitness, ordinal)
        return out._build(ingest.encode(df, kinds, fitness, ordinal, kind, None, levels), n_edit, neighbours_by, generate, tau if filter_mode == "both" else None, keep_isolated)
    df, kinds, levels = _apart(df, kinds, levels, fitness, ordinal)
    given = [c for c in (kinds or df.columns) if c not in (fitness, ordinal)]
    if kind == "boolean":
        df, _, kinds = ingest.parse_boolean(df, given, fitness)
    elif kind in ALPHABETS or kind == "sequence":
        alphabet = ALPHABETS.get(kind) or alphabet or ingest.infer_alphabet(df, given)
        df, _, kinds = ingest.parse_sequence(df, alphabet, given, fitness)
    elif kind in ("ordinal", "categorical"):
        kinds = dict.fromkeys(given, kind)
    elif not kinds:
        raise ParameterError("the default kind needs the kinds of all columns")
    encoded = ingest.encode(df, kinds, fitness, ordinal, kind, alphabet, levels)
    return out._build(encoded, n_edit, neighbours_by, generate, tau if filter_mode == "both" else None, keep_isolated)
