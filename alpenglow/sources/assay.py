"""Mutation assays: from mutant strings and scores to landscapes on the mutated positions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.errors import DataError
from alpenglow.sources.ingest import ALPHABETS, first_of_duplicates

TOKEN = r"^([A-Za-z])(\d+)([A-Za-z])$"


def parse_mutations(mutant: str) -> list[tuple[str, int, str]]:
    """``A1P:D2N`` as [(A, 1, P), (D, 2, N)]; an unreadable token is an error."""
    out = []
    for token in mutant.split(":"):
        m = re.match(TOKEN, token.strip())
        if not m:
            raise DataError(f"can't read mutation {token!r}")
        out.append((m[1].upper(), int(m[2]), m[3].upper()))
    return out


def with_mutations(assay: DataFrame) -> DataFrame:
    """``assay`` with ``muts array<struct<wt, pos, mut>>`` from its column ``mutant``."""
    token = lambda t: F.trim(t)
    part = lambda t, k: F.regexp_extract(token(t), TOKEN, k)
    rows = assay.withColumn("muts", F.transform(F.split("mutant", ":"), lambda t: F.struct(F.upper(part(t, 1)).alias("wt"), part(t, 2).try_cast("int").alias("pos"), F.upper(part(t, 3)).alias("mut"))))
    if bad := rows.where("exists(muts, m -> m.pos is null)").select("mutant").first():
        raise DataError(f"can't read mutations {bad[0]!r}")
    return rows


def infer_target(assay: DataFrame) -> str | None:
    """The wild type: the first full sequence (by ``ordinal`` if there) with its own mutations undone."""
    if "mutated_sequence" not in assay.columns:
        return None
    rows = assay.where("mutated_sequence is not null")
    row = (rows.orderBy("ordinal") if "ordinal" in assay.columns else rows).select("mutated_sequence", "mutant").first()
    if row is None:
        return None
    letters = list(row[0])
    for wt, pos, _ in parse_mutations(row[1]):
        if 1 <= pos <= len(letters):
            letters[pos - 1] = wt
    return "".join(letters)


def dataset_meta(assay: DataFrame, target: str | None) -> DataFrame:
    """One row of counts and moments, in one pass."""
    n = F.size("muts")
    rows = with_mutations(assay)
    positions = rows.select(F.explode("muts.pos").alias("p")).agg(F.count_distinct("p").alias("n_mutated_positions"))
    stats = rows.agg(
        F.lit(len(target) if target else None).cast("int").alias("seq_len"), F.count(F.lit(1)).alias("n_variants_raw"), F.avg(n).alias("avg_n_mutations"), F.percentile(n, F.lit(0.5)).alias("median_n_mutations"),
        F.max(n).alias("max_n_mutations"), F.avg((n == 1).cast("double")).alias("frac_single"), F.avg((n > 1).cast("double")).alias("frac_multi"),
        F.avg("DMS_score").alias("fitness_mean"), F.stddev_pop("DMS_score").alias("fitness_std"), F.min("DMS_score").alias("fitness_min"), F.max("DMS_score").alias("fitness_max"),
    )
    return stats.join(positions)  # one row each


def reduce_to_mutated_positions(assay: DataFrame, target: str | None) -> tuple[DataFrame, list[int]]:
    """``(ordinal, sequences, fitness)``: letters at all mutated positions, and those positions.

    Rows without a score, without a sequence, with a letter outside the twenty, and later
    duplicates are left out. ``assay`` needs a column ``ordinal``.
    """
    rows = with_mutations(assay).where("DMS_score is not null")
    positions = sorted(r[0] for r in rows.select(F.explode("muts.pos").alias("p")).distinct().collect())  # at most a sequence's length
    full = "mutated_sequence" in assay.columns and not rows.where("mutated_sequence is null").limit(1).count()
    at = lambda s: F.concat(*[F.substring(s, p, 1) for p in positions])
    applied = F.lit(None).cast("string")
    if target:
        letters = F.array(*[F.lit(c) for c in target])
        changed = F.aggregate("muts", letters, lambda acc, m: F.transform(acc, lambda x, i: F.when(i + 1 == m["pos"], m["mut"]).otherwise(x)))
        inside = F.forall("muts", lambda m: (m["pos"] >= 1) & (m["pos"] <= len(target)))
        applied = F.when(inside, at(F.array_join(changed, "")))
    own = F.lit(None).cast("string")
    if full:
        fits = F.length("mutated_sequence") == len(target) if target else F.length("mutated_sequence") >= max(positions)
        own = F.when(fits, at(F.col("mutated_sequence")))
    reduced = rows.select("ordinal", F.coalesce(own, applied).alias("sequences"), F.col("DMS_score").cast("double").alias("fitness"))
    kept = reduced.where(F.col("sequences").rlike(f"^[{ALPHABETS['protein']}]{{{len(positions)}}}$"))
    return first_of_duplicates(kept, ["sequences"], "ordinal"), positions


def process_dataset(assay: DataFrame, target: str | None, profile: Callable, min_avg_mutations: float = 1.0) -> dict:
    """``{status, meta, features}``; status is ok, skipped_too_sparse, too_few_variants or build_failed."""
    from alpenglow.plans.landscape import build

    meta = dataset_meta(assay, target).first().asDict()
    if meta["avg_n_mutations"] <= min_avg_mutations:
        return {"status": "skipped_too_sparse", "meta": meta}
    rows, positions = reduce_to_mutated_positions(assay, target)
    meta["n_variants"] = rows.count()
    if meta["n_variants"] < 3:
        return {"status": "too_few_variants", "meta": meta}
    try:
        land = build(rows, kind="protein", ordinal="ordinal")
    except ValueError as e:
        return {"status": "build_failed", "meta": meta, "error": f"{type(e).__name__}: {e}"}
    return {"status": "ok", "meta": meta | {"positions": positions}, "features": profile(land)}


def assemble_table(features: DataFrame, zero_shot: DataFrame | None = None, supervised: DataFrame | None = None, key: str = "DMS_id") -> DataFrame:
    """``features`` with the numeric columns of performance tables, prefixed ``zs_`` and ``sup_``."""
    for table, prefix in ((zero_shot, "zs_"), (supervised, "sup_")):
        if table is not None:
            numeric = [c for c, k in table.dtypes if c != key and (k in ("int", "bigint", "double", "float") or k.startswith("decimal"))]
            features = features.join(table.select(key, *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in numeric]), key, "left")
    return features
