"""Operator 4: secret scans with a random forest that removes false positives.

Candidates are runs of 16 or more key characters, also several joined by dots, blocks of private
keys, quoted values of 6 to 64 characters assigned to a credential word, and passwords in URLs. The
forest judges each by its length, character transitions, dictionary coverage, signs of a path and
the words beside it. It is trained on labelled findings; :func:`made_findings` makes such a set from
formats of keys and of what is mistaken for them.
"""

from __future__ import annotations

import base64
import bisect
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alpenglow.llm import shared
from alpenglow.llm.vector import texts

RUN = re.compile(rb"[A-Za-z0-9_+/\-]{16,}(?:\.[A-Za-z0-9_\-]{16,})*={0,2}")
BLOCK = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]*-----END [A-Z ]{0,40}PRIVATE KEY-----")
QUOTED = re.compile(rb"[:=][ \t]{0,4}([\"'])([^\"'\s]{6,64})\1")
IN_URL = re.compile(rb"://[^\s:/@]{1,64}:([^\s:/@]{4,64})@")
#: Labelled findings that a forest is trained on, and words of the dictionary.
FINDINGS, WORDS = 6_000, 5_000
#: Distinct words that a task counts before it sends them on.
HELD = 200_000
NO_LETTERS = bytes(set(range(256)) - set(b"abcdefghijklmnopqrstuvwxyz"))
BEFORE, AFTER = 48, 24

# Public key prefixes and neighbouring words
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "npm_", "pypi-", "hf_", "eyJ", "-----BEGIN")
KEYWORDS = re.compile(rb"(?i)token|passw|secret|api|key|auth|credential|bearer|pwd")
BENIGN = re.compile(rb"(?i)example|sample|placeholder|uuid|sha\d*\b|commit|checksum|digest|md5|isbn|version|dummy|integrity|hash")
PATHLIKE = re.compile(rb"(?i)https?:|www\.|\.(com|org|net|html?|png|jpe?g|py|js|css|txt|json|md)\b")
NAMES = ("length", "transitions", "log_probability", "coverage", "digits", "capitals", "hex", "distinct", "entropy", "slashes", "path", "assigned", "keyword", "benign", "prefix", "beside_letter")


def candidates(raw: bytes) -> list[tuple[int, int]]:
    """Places of all candidates in order; of overlapping ones the earlier kind stands: block, in a URL, quoted, run."""
    found: list[tuple[int, int]] = []
    if b"-----BEGIN" in raw:
        found += [m.span() for m in BLOCK.finditer(raw)]
    if b"://" in raw and b"@" in raw:
        found += [m.span(1) for m in IN_URL.finditer(raw)]
    found += [m.span(2) for m in QUOTED.finditer(raw) if KEYWORDS.search(raw, max(0, m.start() - 24), m.start())]
    runs = [m.span() for m in RUN.finditer(raw)]
    if not found:
        return runs
    out: list[tuple[int, int]] = []
    for a, b in [*found, *runs]:
        k = bisect.bisect_left(out, (a, b))
        if (not k or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
            out.insert(k, (a, b))
    return out


@dataclass
class Transitions:
    """Log probabilities of a character after another in ordinary words; digits are one class."""

    table: np.ndarray

    @staticmethod
    def codes(raw: bytes) -> np.ndarray:
        x = np.frombuffer(raw.lower(), np.uint8)
        return np.where((x >= 97) & (x <= 122), x - 97, np.where((x >= 48) & (x <= 57), 26, 27)).astype(np.int64)

    @classmethod
    def fit(cls, words: Iterable[str]) -> Transitions:
        n = np.full((28, 28), 0.1)
        for w in words:
            c = cls.codes(w.encode())
            np.add.at(n, (c[:-1], c[1:]), 1)
        return cls(np.log(n / n.sum(axis=1, keepdims=True)))

    def mean(self, raw: bytes) -> float:
        c = self.codes(raw)
        return float(self.table[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0


def coverage(raw: bytes, words: frozenset[str]) -> float:
    """Share of the candidate's characters that words of four or more letters cover, longest first from the left."""
    s, at, got = raw.decode("ascii", "replace").lower(), 0, 0
    while at + 4 <= len(s):
        for k in range(min(14, len(s) - at), 3, -1):
            if s[at : at + k] in words:
                got, at = got + k, at + k
                break
        else:
            at += 1
    return got / max(len(s), 1)


@dataclass
class Features:
    words: frozenset[str]
    transitions: Transitions

    def of(self, raw: bytes, start: int, end: int) -> list[float]:
        value, before, after = raw[start:end], raw[max(0, start - BEFORE) : start], raw[end : end + AFTER]
        x = np.frombuffer(value, np.uint8)
        kind = np.select([(x >= 48) & (x <= 57), (x >= 65) & (x <= 90), (x >= 97) & (x <= 122)], [0, 1, 2], 3)
        share = np.bincount(x)[np.unique(x)] / len(x)
        near = before.rsplit(b"\n", 1)[-1]
        return [
            len(x), float((np.diff(kind) != 0).mean()), self.transitions.mean(value), coverage(value, self.words), float((kind == 0).mean()), float((kind == 1).mean()),
            float(re.fullmatch(rb"[0-9a-fA-F]+", value) is not None), len(share) / len(x), float(-(share * np.log2(share)).sum()), float((x == 47).sum()),
            float(PATHLIKE.search(near[-24:] + value + after[:8]) is not None), float(near.rstrip(b" \"'").endswith((b"=", b":"))),
            float(KEYWORDS.search(near) is not None), float(BENIGN.search(near + b" " + after) is not None),
            float(value.startswith(tuple(p.encode() for p in PREFIXES))), float((near[-1:] >= b"\x80") + (after[:1] >= b"\x80")),
        ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 11) -> Forest:
        rng = np.random.default_rng(seed)
        return cls([cls._tree(x[rows], y[rows], depth, least, rng) for rows in (rng.integers(0, len(y), len(y)) for _ in range(trees))])

    @staticmethod
    def _tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if level == depth or len(rows) < 2 * least or nodes[at][4] in (0.0, 1.0):
                return at
            found = (0.0, -1, 0.0)
            whole = nodes[at][4] * (1 - nodes[at][4]) * len(rows)
            for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, positive = x[rows[order], f], np.cumsum(y[rows[order]])
                n = np.arange(1, len(rows))
                a, b = positive[:-1] / n, (positive[-1] - positive[:-1]) / (len(rows) - n)
                gain = whole - a * (1 - a) * n - b * (1 - b) * (len(rows) - n)
                gain[(v[1:] == v[:-1]) | (n < least) | (len(rows) - n < least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > found[0] + 1e-12:
                    middle = float(v[k] + (v[k + 1] - v[k]) / 2)
                    found = (float(gain[k]), int(f), middle if middle < v[k + 1] else float(v[k]))
            if found[1] >= 0:
                low = x[rows, found[1]] <= found[2]
                nodes[at][:2] = found[1:]
                nodes[at][2] = grow(rows[low], level + 1)
                nodes[at][3] = grow(rows[~low], level + 1)
            return at

        grow(np.arange(len(y)), 0)
        n = np.array(nodes)
        return n[:, 0].astype(np.int64), n[:, 1], n[:, 2].astype(np.int64), n[:, 3].astype(np.int64), n[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(go := np.flatnonzero(feature[at] >= 0)):
                f = feature[at[go]]
                at[go] = np.where(x[go, f] <= threshold[at[go]], left[at[go]], right[at[go]])
            total += value[at]
        return total / max(len(self.trees), 1)


@dataclass
class Scanner:
    features: Features
    forest: Forest
    threshold: float = 0.5

    def scan(self, raw: bytes) -> list[tuple[int, int, float]]:
        """(start, end, score) of every candidate in bytes, in order."""
        spans = candidates(raw)
        if not spans:
            return []
        scores = self.forest.score(np.array([self.features.of(raw, a, b) for a, b in spans]))
        return [(a, b, float(s)) for (a, b), s in zip(spans, scores)]


def made_findings(words: list[str], n: int = FINDINGS, seed: int = 17) -> list[tuple[bytes, int, int, int]]:
    """Labelled findings ``(text, start, end, 1 if a secret)``, half of each, in sentences of the given words."""
    rng = random.Random(seed)
    plain = words or ["lorem", "ipsum", "dolor", "amet", "consetetur", "sadipscing"]
    low, alnum, hexa, b32 = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    some = lambda letters, k: "".join(rng.choices(letters, k=k))
    said = lambda k: " ".join(rng.choices(plain, k=k))
    joined = lambda sep: sep.join(rng.choices(plain, k=rng.randint(3, 6)))
    name = lambda: rng.choice(("token", "password", "secret", "api_key", "apikey", "auth_token", "SECRET_KEY", "client_secret", "pwd", "access_key"))
    assign = lambda v: rng.choice((f'{name()} = "{v}"', f"{name()}={v}", f"{name()}: {v}", f"{name()} = '{v}'", f"Authorization: Bearer {v}"))
    key = lambda: rng.choice((some(hexa, rng.choice((18, 20, 32, 40, 64))), some(alnum, rng.randint(18, 48)), base64.b64encode(rng.randbytes(rng.randint(18, 33))).decode(), some(hexa, rng.randint(16, 48))))
    secret = (
        lambda: (v := rng.choice(("AKIA", "ASIA")) + some(b32, 16), v),
        lambda: (v := rng.choice(PREFIXES[2:]) + some(alnum, rng.randint(20, 40)), rng.choice((v, assign(v)))),
        lambda: (v := key(), assign(v)),
        lambda: (v := key(), assign(v)),
        lambda: (v := "eyJ" + ".".join(some(alnum + "_-", rng.randint(18, 60)) for _ in range(3)), rng.choice((v, assign(v)))),
        lambda: (v := some(alnum + "!@#$%^&*?", rng.randint(8, 20)), f"{name()} {rng.choice(':=')} \"{v}\""),
        lambda: (v := some(alnum + "!#$%", rng.randint(8, 20)), f"{rng.choice(('postgres', 'https', 'redis', 'ftp'))}://{rng.choice(plain)}:{v}@{rng.choice(plain)}.example/{rng.choice(plain)}"),
        lambda: (v := f"-----BEGIN {(k := rng.choice(('', 'RSA ', 'EC ', 'OPENSSH ')))}PRIVATE KEY-----\n" + "\n".join(some(alnum + "+/", 64) for _ in range(rng.randint(2, 12))) + f"\n-----END {k}PRIVATE KEY-----", v),
    )
    other = (
        lambda: (v := joined(rng.choice(("", "", "-", "_", "/"))), v),
        lambda: (v := some(low, rng.randint(16, 30)), v),
        lambda: (v := str(uuid.UUID(int=rng.getrandbits(128))), rng.choice((v, f"uuid {v}", f"id: {v}"))),
        lambda: (v := some(hexa, rng.choice((32, 40, 64))), rng.choice((f"commit {v}", f"sha256 {v}", f"md5 checksum {v}", f"digest: {v}"))),
        lambda: (v := "/".join(rng.choices(plain, k=4)) + f"/{rng.randint(0, 9999)}", rng.choice((f"https://{v}", f"www.{v}.html", v))),
        lambda: (v := some("0123456789", rng.randint(16, 24)), rng.choice((f"isbn {v}", v))),
        lambda: (v := rng.choice(("x", "-", "_", "0", "a")) * rng.randint(16, 40), rng.choice((v, assign(v)))),
        lambda: (v := rng.choice(("your", "example", "changeme", "placeholder", "insert")) + joined("_"), assign(v)),
        lambda: (v := rng.choice(("changeme", "xxxxxxxx", "********", "<password>", "${PASSWORD}", rng.choice(plain) + rng.choice(plain), "example-" + rng.choice(plain))), f"{name()} {rng.choice(':=')} \"{v}\""),
        lambda: (v := rng.choice(("password", "changeme", "xxxx", "PASSWORD", rng.choice(plain) + "word")), f"https://{rng.choice(plain)}:{v}@example.org/{rng.choice(plain)}"),
        lambda: (v := ".".join(joined("_") + "letters" for _ in range(rng.randint(2, 3))), v),
    )
    out = []
    while len(out) < n:
        label = len(out) % 2
        value, shown = rng.choice(secret if label else other)()
        text = f"{said(rng.randint(0, 8))} {shown} {said(rng.randint(0, 6))}".strip().encode()
        at = text.rfind(value.encode())
        span = next(((a, b) for a, b in candidates(text) if a <= at < b), None)
        if span and (not label or span[0] == at):
            out.append((text, *span, label))
    return out


def dictionary(docs: DataFrame, size: int = WORDS) -> list[str]:
    """The most frequent words of four to fourteen letters a-z, any case, counted over all texts; what follows the letters doesn't count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def told() -> pa.RecordBatch:
            words: Counter[bytes] = Counter()
            for w, n in held.items():
                w = w.rstrip(NO_LETTERS)
                if 4 <= len(w) <= 14 and w.isalpha():  # of bytes: ASCII letters only
                    words[w] += n
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

        for _, raw in texts(batches):
            for x in raw:
                held.update(x.lower().split())
            if len(held) > HELD:
                yield told()
                held = Counter()
        yield told()

    counted = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in shared.top(counted, "n", size, "word").collect()]


def train(words: list[str], findings: list[tuple[bytes, int, int, int]] | None = None) -> Scanner:
    """A scanner whose forest is fitted on ``findings`` (by default :func:`made_findings`)."""
    features = Features(frozenset(words), Transitions.fit(words))
    rows = made_findings(words) if findings is None else findings
    x = np.array([features.of(t, a, b) for t, a, b, _ in rows])
    return Scanner(features, Forest.fit(x, np.array([y for *_, y in rows], float)))


def scan(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """One row a candidate: ``(doc_id, start, length, sha256, score, is_secret)``, places in bytes of the text's UTF-8.

    Null and empty texts, and texts without candidates, give no rows. Null or repeated doc_ids
    stay as they are. An empty table gives an empty result; extra columns are not read.
    """
    import hashlib

    sent = docs.sparkSession.sparkContext.broadcast(scanner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch, raw in texts(batches):
            rows = [(k, a, b - a, hashlib.sha256(x[a:b]).hexdigest(), p) for k, x in enumerate(raw) for a, b, p in s.scan(x)]
            doc, start, length, digest, score = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(digest, pa.string()), pa.array(score, pa.float64()), pa.array([p >= s.threshold for p in score], pa.bool_())],
                names=["doc_id", "start", "length", "sha256", "score", "is_secret"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, start long, length long, sha256 string, score double, is_secret boolean")


def redact(docs: DataFrame, scanner: Scanner, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``; other columns, whatever their names, and null texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    at = docs.columns.index("text")
    fields = [T.StructField("text", T.StringType()) if k == at else f for k, f in enumerate(docs.schema.fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        for batch, raw in texts(batches, f"_{at}"):
            null = np.asarray(batch.column(at).is_null())
            out = []
            for x, z in zip(raw, null):
                parts, end = [], 0
                for a, b, p in s.scan(x):
                    if p >= s.threshold:
                        parts += [x[end:a], mark.encode()]
                        end = b
                out.append(None if z else b"".join((*parts, x[end:])).decode("utf-8", "replace"))
            cols = list(batch.columns)
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return docs.toDF(*(f"_{k}" for k in range(len(fields)))).mapInArrow(run, T.StructType(fields))
