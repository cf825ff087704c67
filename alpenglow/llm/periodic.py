"""Operator 13: runs of repeating words by Main-Lorentz divide and conquer.

Words are interned as numbers. A text is halved again and again; at each midpoint two Z-functions,
of the right half before the whole and of the reversed left half before the reversed whole, tell for
every period how far words that are that period apart agree on both sides. That gives each
repetition across the midpoint with its full extent inside the segment; one that goes on beyond the
segment crosses an earlier midpoint and was found there. Intervals found more than once keep their
smallest period.

Before that, texts are cut exactly: in a run of three periods or more each word comes three times or
more, so words that come less often in their stretch end it, and stretches shorter than the least
run are done with, again and again until nothing changes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared
from alpenglow.llm.vector import texts

#: Least words and periods of a run.
LEAST, TIMES = 24, 3
Run = tuple[int, int, int]


def z_function(s: list[int]) -> list[int]:
    """For each place but the first, the length of the longest common prefix of ``s`` and what begins there."""
    n = len(s)
    z = [0] * n
    a = b = 0
    for i in range(1, n):
        k = 0
        if i < b:
            k = z[i - a]
            if k < b - i:
                z[i] = k
                continue
            k = b - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > b:
            a, b = i, i + k
    return z


def repetitions(s: list[int], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """(start, length, period) of all maximal runs of at least ``least`` symbols and ``times`` (two or more) smallest periods, in order."""
    found: dict[tuple[int, int], int] = {}
    stack = [(0, len(s))]
    while stack:
        low, high = stack.pop()
        size = high - low
        if size < max(least, times, 2):
            continue
        mid = (low + high) // 2
        stack += [(low, mid), (mid, high)]
        whole, right, left = s[low:high], s[mid:high], s[low:mid][::-1]
        onward = z_function([*right, -1, *whole])[len(right) + 1 :] + [0]  # of every place and the midpoint
        back = z_function([*left, -1, *whole[::-1]])[len(left) + 1 :] + [0]
        for p in range(1, size // times + 1):
            for at in (mid + p, mid - p):
                if not low <= at <= high:
                    continue
                ahead, behind = onward[at - low], back[high - at]
                if ahead + behind < max(least, times * p) - p:
                    continue
                start, end = min(mid, at) - behind, max(mid, at) + ahead
                if (start == low and start and s[start - 1] == s[start - 1 + p]) or (end == high < len(s) and s[end] == s[end - p]):
                    continue
                found[start, end] = min(p, found.get((start, end), p))
    return sorted((a, b - a, p) for (a, b), p in found.items())


def stretches(ids: np.ndarray, doc: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[np.ndarray]:
    """Places of the stretches that can hold a run: consecutive words of one text, each ``times`` times or more among them."""
    at, part = np.arange(len(ids)), doc.astype(np.int64)
    while len(at):
        _, own, n = np.unique(part * (int(ids.max()) + 1) + ids[at], return_inverse=True, return_counts=True)
        often = n[own] >= times
        kept, of = at[often], part[often]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) != 1) | (of[1:] != of[:-1])
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least if len(part) else np.zeros(0, bool)
        before, at, part = len(at), kept[long], part[long]
        if len(at) == before:
            return np.split(at, np.flatnonzero(np.diff(part)) + 1)
    return []


def batch_runs(docs: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, given as its words."""
    size = np.array([len(d) for d in docs], np.int64)
    begin = np.cumsum(size) - size
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for d in docs for w in d), np.int64, int(size.sum()))
    out: list[list[Run]] = [[] for _ in docs]
    for places in stretches(ids, np.repeat(np.arange(len(docs)), size), least, times):
        k = int(np.searchsorted(begin, places[0], "right")) - 1
        shift = int(places[0] - begin[k])
        out[k] += [(a + shift, n, p) for a, n, p in repetitions(ids[places].tolist(), least, times)]
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words that no run has after its first period, joined by one space."""
    keep = bytearray(b"\1") * len(words)
    for start, length, period in runs:
        keep[start + period : start + length] = bytes(length - period)
    return b" ".join([w for w, k in zip(words, keep) if k] if runs else words)


def _each(batches: Iterator[pa.RecordBatch], least: int = LEAST, times: int = TIMES) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]], list[list[Run]]]]:
    for batch, raw in texts(batches):
        docs = [d.split() for d in raw]  # bytes are split at space and tab to carriage return, as the words are defined
        yield batch, docs, batch_runs(docs, least, times)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``(id, start, length, period)`` of every run of words, numbered from 0, in every row's text.

    Words are stretches without space and tab to carriage return. Null and empty texts, and those of
    fewer than ``least`` words, have no runs; null and repeated ids stay as they are; an empty table gives
    no rows; other columns are not read. A text is worked on whole, at some 200 bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, found in _each(batches, least, times):
            flat = [r for runs in found for r in runs]
            if flat:
                own = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(r) for r in found])))
                yield pa.RecordBatch.from_arrays([own, *[pa.array(c, pa.int64()) for c in zip(*flat)]], names=["id", "start", "length", "period"])

    kind = docs.schema[id_col].dataType.simpleString()
    return _rows(docs, id_col, text_col).mapInArrow(run, f"id {kind}, start long, length long, period long").withColumnRenamed("id", id_col)


def collapse(docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """``docs`` whose texts with runs have them once: :func:`find_runs` tells what a run is. Other rows, null texts too, and all columns stay."""
    given, moved = docs.columns, shared.free_name(docs, "collapsed")
    rows = docs.select(F.struct(*[docs[c] for c in given]).alias("rest"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, found in _each(batches, least, times):
            new = [collapsed(w, r).decode("utf-8", "replace") if r else None for w, r in zip(words, found)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["rest", moved])

    done = rows.mapInArrow(run, f"rest {rows.schema['rest'].dataType.simpleString()}, {moved} string")
    own = {c: F.col("rest").getField(c) for c in given}
    return done.select(*[(F.coalesce(F.col(moved), x) if c == text_col else x).alias(c) for c, x in own.items()])


def digests(docs: DataFrame) -> DataFrame:
    """Per document: n_runs; of the run of greatest length over period (then least start, period) start, length, period and exponent_milli, null without one; digests of all runs and of the collapsed text.

    Nulls, ids, empty tables and columns as for :func:`find_runs`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, words, found in _each(batches):
            top = [min(r, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if r else (None, None, None) for r in found]
            each = [hashlib.sha256("".join(f"{a},{n},{p}\n" for a, n, p in r).encode()).hexdigest() for r in found]
            left = [hashlib.sha256(collapsed(w, r)).hexdigest() for w, r in zip(words, found)]
            long = lambda x: pa.array(x, pa.int64())
            columns = [long([len(r) for r in found]), *[long([t[i] for t in top]) for i in range(3)], long([None if n is None else 1000 * n // p for _, n, p in top])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(each, pa.string()), pa.array(left, pa.string())], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _rows(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the contract's repetitions: in a tenth of the documents, by crc32 of the id, words from some place on repeat."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size("w")
    rows = docs.select("doc_id", docs["text"].cast("string").alias("text")).withColumn("w", F.when(h % 10 == 0, words))
    rows = rows.withColumn("a", F.when(n > 0, g % n)).withColumn("p", F.when(n > 0, 1 + F.floor((n - F.col("a")) / (3 + g % 8))))
    again = F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))
