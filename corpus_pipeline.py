"""Corpus pipeline: toxicity, near-duplicates, repeated passages, secrets, packing.

Every stage takes the documents that its predecessor kept, with all their columns, whatever these
are called; the last returns packed pieces. Null texts stay null (and pack as empty), null and
repeated doc_ids stay, and an empty table gives an empty table. ``run`` applies the stages to the
table ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alpenglow.llm import near_copies, packing, secret_scan, shared, suffixes, toxicity
from alpenglow.llm.queries import WORD_MODEL


def _sized(docs: DataFrame) -> DataFrame:
    """n_chars, if there is such a column, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity, learned from the labels outside fold 0, is below one half.

    Null and empty texts get the score of a text without known terms. Without labels of both kinds
    there is no model, and all documents stay. A column called toxicity stays what it is.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = shared.free_name(docs, "toxicity")
    said = F.col(name) < 0.5 if model.trained else F.lit(True)
    return toxicity.score(docs, model, name).where(said).drop(name)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies (5-word shingles, Jaccard of 0.8 or more): that of the smallest doc_id, null ids last.

    SimHash fingerprints bring texts together first, by operator 3's tiles; sets of shingles confirm
    these links and find those that fingerprints miss.

    Rows that share a doc_id but not the text are documents of their own; within a component the one
    of least text hashes stays. Texts without words, null ones too, are copies of each other.
    """
    return near_copies.one_of_each(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier; n_chars follows. No row goes, and null texts stay null."""
    return _sized(suffixes.without_repeats(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with secrets replaced; n_chars follows. No row goes, and null texts stay null."""
    return _sized(secret_scan.redact(docs, secret_scan.train(secret_scan.dictionary(docs))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, as few as best fit finds. A null text packs as an empty one; other columns are not read."""
    return packing.pack(docs, public_tokenizers.path(WORD_MODEL))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash_near_dedup", keep_one_of_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("secret_scan", redact_secrets),
    ("best_fit_packing", pack),
]

#: SQL has no form for the learned and sequential stages; the chain is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written for itself goes once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = shared.fresh(spark, name)
        with shared.scratch(spark):
            docs = stage(spark, docs, sf_dir)
            schema = docs.schema
            docs.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
