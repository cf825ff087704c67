import binascii
import hashlib
import random
from fractions import Fraction

import pytest

from alpenglow.llm import periodic


def plain(s, least=24, times=3):
    """Every maximal run by trying all periods from all places, the smallest period of an interval only."""
    n, found = len(s), {}
    for p in range(1, n // times + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and s[j] == s[j + p]:
                j += 1
            if j - i + p >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items())


def words(rng, n, letters):
    out = []
    while len(out) < n:
        kind = rng.randrange(4)
        part = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
        out += part * rng.randint(2, 9) + part[: rng.randint(0, len(part))] if kind else part * 1
    return out[:n]


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (2, 2), (9, 3), (1, 4)])
def test_repetitions_against_brute_force(least, times):
    rng = random.Random(least * 10 + times)
    for _ in range(150):
        s = words(rng, rng.randint(0, 140), list(range(rng.choice([1, 2, 3, 30]))))
        want = plain(s, least, times)
        assert periodic.repetitions(s, least, times) == want
        raw = [str(x).encode() for x in s]
        assert periodic.batch_runs([raw, [], raw[::-1], raw], least, times)[::3] == [want, want]


def test_z_function():
    rng = random.Random(1)
    for _ in range(100):
        s = [rng.randrange(2) for _ in range(rng.randint(1, 40))]
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s)[1:] == want[1:]


def test_nested_runs_are_all_found():
    inner = [1] * 24 + [2, 3]
    runs = periodic.repetitions(inner * 3)
    assert (0, 78, 26) in runs and [(a, n) for a, n, p in runs if p == 1] == [(0, 24), (26, 24), (52, 24)]


def row(i, text):
    """The contract, one document at a time."""
    w = (text or "").encode().split()
    n, h = len(w), binascii.crc32(str(i).encode()) if i is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = plain(w)
    drop = {k for a, length, q in runs for k in range(a + q, a + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (i, len(runs), *top, 1000 * top[1] // top[2] if runs else None, sha("".join(f"{a},{x},{q}\n" for a, x, q in runs).encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in drop)))


def test_digests_against_brute_force(frame, odd):
    rng = random.Random(4)
    docs = [(i, rng.choice([" ", "\t\n "]).join(map(str, words(rng, rng.randint(0, 200), range(40))))) for i in range(300)] + [(10_000 + i, t) for i, (_, t) in enumerate(odd)]
    docs += [(None, "a " * 30), (5, docs[5][1]), (20_000, " x" * 3000)]
    df = frame(docs)
    got = periodic.digests(periodic.planted(df))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((row(i, t) for i, t in docs), key=repr)
    assert periodic.digests(periodic.planted(frame([]))).count() == 0


def test_runs_and_collapsed_texts(spark):
    df = spark.createDataFrame([(1, "x " + "a b " * 20 + "y", 7), (2, "kept  as it\tis", 8), (None, None, 9), (3, "", 1)], "doc_id long, text string, collapsed int")
    assert list(map(tuple, periodic.find_runs(df).collect())) == [(1, 1, 40, 2)]
    got = periodic.collapse(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "x a b y", 7), (2, "kept  as it\tis", 8), (None, None, 9), (3, "", 1)], key=repr)
