"""Operator 6: token counts by a digest cache.

The digest of a text's normalised content (null: empty; the UTF-8 bytes otherwise unchanged, as
each of them may change a count) is joined with the stored counts of the same tokenizer version.
Only distinct texts without a count are encoded, and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared
from alpenglow.llm.pieces import codec
from alpenglow.llm.vector import texts

CACHE = "digest binary, n_tokens long, tokenizer string"


def version(model: str) -> str:
    """Digest of the tokenizer: its file and the encoding rules applied here."""
    return hashlib.sha256(b"pieces, no begin, no end\0" + Path(model).read_bytes()).hexdigest()


def stored(docs: DataFrame, cache: str, tokenizer: str) -> DataFrame:
    """``(digest, n_tokens)`` kept in ``cache`` for this tokenizer; empty where there is no cache yet."""
    spark = docs.sparkSession
    if not shared.exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    kept = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have added one digest


def count(docs: DataFrame, model: str, cache: str, limit: int = 4096) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` of every row; ``cache`` is a table path that grows by what is new.

    Null texts count as empty (0 tokens). Repeated rows and equal texts give one row each but are
    encoded once. Null doc_ids stay. An empty table gives an empty result. Extra columns are not read.
    """
    tokenizer = version(model)
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, raw in texts(batches):
            _, at = c.encode(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64())], names=["digest", "n_tokens"])

    missing = keyed.select("digest", "text").join(stored(docs, cache, tokenizer), "digest", "left_anti").dropDuplicates(["digest"])
    new = missing.mapInArrow(encode, "digest binary, n_tokens long")
    new.withColumn("tokenizer", F.lit(tokenizer)).write.mode("append").partitionBy("tokenizer").parquet(cache)
    sized = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
    return sized.join(stored(docs, cache, tokenizer), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
