"""Operator 10: toxicity by a factorization machine over hashed terms.

Terms are a text's words and their beginnings of four to six bytes, hashed to 64 bits. The model
keeps the ``TERMS`` terms that differ most between toxic and other labelled texts (by chi-square,
counted in Spark); a text has each of them or not. The machine adds to the linear weights an inner
product of two terms' factors for each pair of them that a text has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alpenglow.errors import ParameterError
from alpenglow.llm import shared
from alpenglow.llm.vector import PrefixHash, offsets, segment_sum, texts

#: Labelled rows that a model is fitted on at most, dealt by a hash of doc_id; scoring has no limit.
MAX_LABELLED = 24_000
#: Terms kept, and the chi-square below which a term says nothing.
TERMS, LEAST_CHI2 = 8_192, 10.8
BEGINNINGS = (4, 5, 6)
FOLDS = 5

_WORD = np.zeros(256, bool)
_WORD[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(0x80, 0x100)]] = True


def terms(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all texts, and the text that each belongs to; a text's terms may repeat."""
    low = [d.decode("utf-8", "replace").lower().encode() + b"\n" for d in docs]
    flat = np.frombuffer(b"".join(low), np.uint8)
    inside = _WORD[flat]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    start, end = edge[::2], edge[1::2]
    doc = np.searchsorted(offsets(np.array([len(x) for x in low])), start, "right") - 1
    spans = PrefixHash(flat)
    out, of = [spans.span(start, end)], [doc]
    for k, n in enumerate(BEGINNINGS):
        long = end - start > n
        # a beginning is another term than a whole word of its letters
        out.append(spans.span(start[long], start[long] + n) ^ np.uint64(k + 1))
        of.append(doc[long])
    return np.concatenate(out), np.concatenate(of)


@dataclass
class FactorizationMachine:
    """``known``: sorted hashes of its terms; score = sigmoid(bias + sum w + pairwise inner products)."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    trained: bool = False  # whether there were labels of both kinds

    def active(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the model's terms that each text has, once each, and each text's bounds."""
        n = len(docs)
        if not len(self.known):
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        h, doc = terms(docs)
        maybe = self._filter()[(h >> np.uint64(46)).astype(np.int64)]
        h, doc = h[maybe], doc[maybe]
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        hit = self.known[at] == h
        both = np.unique(doc[hit] * len(self.known) + at[hit])
        return both % len(self.known), np.searchsorted(both, np.arange(n + 1) * len(self.known))

    def _filter(self) -> np.ndarray:
        if not hasattr(self, "_seen"):
            self._seen = np.zeros(1 << 18, bool)
            self._seen[(self.known >> np.uint64(46)).astype(np.int64)] = True
        return self._seen

    def margin(self, term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = self.bias + segment_sum(self.weight[term], bounds)
        v = self.factor[term]
        for f in range(v.shape[1]):
            out += 0.5 * (segment_sum(v[:, f], bounds) ** 2 - segment_sum(v[:, f] ** 2, bounds))
        return out

    def scores(self, docs: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.active(docs)), -50, 50)))

    def fit(self, term: np.ndarray, bounds: np.ndarray, y: np.ndarray, epochs: int | None = None, batch: int = 256, rate: float = 0.1, decay: float = 1e-4) -> FactorizationMachine:
        """AdaGrad on the logistic loss; the same rows in the same order give the same model.

        Few rows are gone over more often, for some 6,000 steps in all.
        """
        epochs = epochs or min(max(12, 6000 * batch // max(len(y), 1)), 200)
        rng = np.random.default_rng(7)
        m, k = len(self.known), self.factor.shape[1]
        self.factor = rng.normal(0, 0.02, (m, k))
        gw, gv, gb = np.full(m, 1e-6), np.full((m, k), 1e-6), 1e-6
        size = np.diff(bounds)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for a in range(0, len(order), batch):
                rows = order[a : a + batch]
                n = size[rows]
                at = offsets(n)
                own = np.repeat(np.arange(len(rows)), n)
                t = term[np.repeat(bounds[rows] - at[:-1], n) + np.arange(at[-1])]
                g = (1 / (1 + np.exp(-np.clip(self.margin(t, at), -50, 50))) - y[rows]) / len(rows)
                gb += g.sum() ** 2
                self.bias -= rate * g.sum() / np.sqrt(gb)
                u, place = np.unique(t, return_inverse=True)
                if not len(u):
                    continue
                d = np.bincount(place, g[own], len(u)) + decay * self.weight[u]
                gw[u] += d**2
                self.weight[u] -= rate * d / np.sqrt(gw[u])
                v = self.factor[t]
                total = np.stack([segment_sum(v[:, f], at) for f in range(k)], axis=1)
                each = g[own][:, None] * (total[own] - v)
                d = np.stack([np.bincount(place, each[:, f], len(u)) for f in range(k)], axis=1) + decay * self.factor[u]
                gv[u] += d**2
                self.factor[u] -= rate * d / np.sqrt(gv[u])
        return self


def fold(doc_id: str = "doc_id", folds: int = FOLDS):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, factors: int = 8, max_labelled: int = MAX_LABELLED) -> FactorizationMachine:
    """A model of the labelled documents outside fold 0. Labels that are null or contradict each other for one doc_id are not used."""
    spark = docs.sparkSession
    agreed = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    chosen = agreed.where((F.col("toxic") == F.col("other")) & (fold() != 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at most max_labelled ids, and one text of each (the least) if rows share one
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    sample = shared.written(found.select("doc_id", "text", "toxic"), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches):
            y = np.asarray(batch.column(2))
            h, doc = terms(raw)
            once = np.unique(np.stack((h, doc.astype(np.uint64)), axis=1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
            u, place, n = np.unique(once[:, 0], return_inverse=True, return_counts=True)
            toxic = np.bincount(place, y[once[:, 1].astype(np.int64)], len(u)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n, pa.int64()), pa.array(toxic)], names=["term", "n", "toxic"])

    sizes = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    total, positive = int(sizes[0]), int(sizes[1])
    n, k = F.col("n").cast("double"), F.col("toxic").cast("double")
    rest = float(max(total - positive, 0))
    # chi-square of the 2 x 2 table of term and label
    odd = k * (F.lit(rest) - (n - k)) - (n - k) * (F.lit(float(positive)) - k)
    chi2 = F.lit(float(total)) * odd * odd / (n * (F.lit(float(total)) - n) * F.lit(max(float(positive), 1e-9)) * F.lit(max(rest, 1e-9)))
    counted = sample.select("doc_id", "text", "toxic").mapInArrow(count, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    best = counted.where((F.col("n") >= 3) & (F.col("n") < total)).withColumn("chi2", chi2).where(F.col("chi2") >= LEAST_CHI2)
    known = np.sort(np.array([r[0] for r in shared.top(best, "chi2", TERMS, "term").select("term").collect()], np.int64).view(np.uint64))
    model = FactorizationMachine(known, float(np.log((positive + 0.5) / (rest + 0.5))), np.zeros(len(known)), np.zeros((len(known), factors)))
    if not positive or not rest:
        return model
    sent = spark.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches):
            term, at = sent.value.active(raw)
            lists = pa.LargeListArray.from_arrays(pa.array(at, pa.int64()), pa.array(term.astype(np.int32))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists], names=["doc_id", "toxic", "terms"])

    got = sample.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, terms array<int>").orderBy("doc_id").toArrow()
    lists = got.column("terms").combine_chunks()
    model.trained = True
    return model.fit(np.asarray(lists.flatten()).astype(np.int64), offsets(np.asarray(lists.value_lengths()).astype(np.int64)), np.asarray(got.column("toxic")).astype(float))


def score(docs: DataFrame, model: FactorizationMachine, name: str = "toxicity") -> DataFrame:
    """``docs`` with its score (0 to 1) as a last column ``name``, which must be a new one; other columns stay. Null texts count as empty."""
    if shared.free_name(docs, name) != name:
        raise ParameterError(f"there is a column {name} already")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches, f"_{docs_text}"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(raw))], names=schema.names)

    docs_text = docs.columns.index("text")
    return docs.toDF(*(f"_{k}" for k in range(len(docs.columns)))).mapInArrow(run, schema)  # whatever the names


def score_held_out(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of every row, by a model of the labelled rows outside fold 0.

    Null texts count as empty and get the score of a text without known terms. Rows with a null
    doc_id are scored, with held_out false. Without labels of both kinds all scores are the smoothed
    share of toxic labels. Repeated rows give repeated results; an empty table none; extra columns
    are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = score(rows, train(docs, labels))
    return scored.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def crc_fold(doc_id: int, folds: int = FOLDS) -> int:
    """:func:`fold` of one id, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds
