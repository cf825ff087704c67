import hashlib
import random

import numpy as np
import pytest
import xxhash

from alpenglow.llm import simhash, suffixes
from alpenglow.llm.vector import PrefixHash


def removed(docs, length):
    """Brute force over (key, bytes) in order: per key the covered bytes."""
    seen, out = {}, {}
    for k, b in docs:
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (k, p)) < (k, p):
                cover[p : p + length] = b"\1" * length
        out[k] = cover
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(40) for _ in range(4)]
    docs = []
    for i in range(n):
        kind = rng.randrange(5)
        t = text(rng.randint(0, 60))
        if kind == 0 and docs:
            t = rng.choice(docs)[1]
        elif kind == 1 and docs:
            w = (rng.choice(docs)[1] or "").split()
            if w:
                w[rng.randrange(len(w))] = word()
            t = " ".join(w)
        elif kind == 2:
            t = f"{t} {rng.choice(shared)} {text(20)} {rng.choice(shared)}"
        docs.append((i, t))
    docs.append((n, "ab" * 300))
    docs.append((n + 1, "ab" * 200 + "c" * 250))
    return docs


@pytest.mark.parametrize("hot", [4096, 1])
def test_suffix_dedup_against_brute_force(frame, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    docs = corpus(1)
    want = removed([(i, t.encode()) for i, t in docs], 100)
    got = {r.doc_id: r for r in suffixes.digests(frame(docs)).collect()}
    for i, t in docs:
        cover, raw = want[i], t.encode()
        spans = sum(1 for k, c in enumerate(cover) if c and (not k or not cover[k - 1]))
        kept = bytes(x for x, c in zip(raw, cover) if not c)
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), sum(cover), spans, hashlib.sha256(kept).hexdigest())


def test_suffix_dedup_on_odd_rows(frame, odd):
    got = suffixes.digests(frame(odd)).collect()
    assert len(got) == len(odd) and suffixes.digests(frame([])).count() == 0
    twice = [r for r in got if r.doc_id == 7]
    assert len(twice) == 2 and twice[0] == twice[1]
    left = suffixes.without_repeats(frame(odd))
    assert left.columns == frame(odd).columns and {r.doc_id: r.text for r in left.collect()}[1] is None
    same = "one text that is long enough to be a repeated string of a hundred bytes, and then some more bytes to be sure of it"
    rows = suffixes.digests(frame([(5, same), (None, same), (5, same + "!")])).collect()
    assert sorted((r.doc_id is None, r.n_removed > 0) for r in rows) == [(False, True), (False, True), (True, False)]


def alike(frame, docs):
    """The operator's rows beside brute force, for distinct ids."""
    want = removed([(i, t.encode()) for i, t in sorted(docs)], 100)
    got = {r.doc_id: r for r in suffixes.digests(frame(docs)).collect()}
    for i, t in docs:
        kept = bytes(x for x, c in zip(t.encode(), want[i]) if not c)
        assert (got[i].n_removed, got[i].kept_sha256) == (sum(want[i]), hashlib.sha256(kept).hexdigest())
    return {i: sum(c) for i, c in want.items()}


def collision():
    """Two differing ASCII texts of 164 bytes, with a common part of 60, whose polynomial hashes modulo 2^64 are equal for the second base."""
    p = np.array([1])
    for q in [[-1, 0, 1]] * 9 + [[1, 1], [-1] + [0] * 31 + [1], [-1] + [0] * 111 + [1]]:
        p = np.convolve(p, q)
    b = np.where(p == 0, 97, np.maximum(0, -p))
    return bytes((b + p).tolist()).decode("ascii"), bytes(b.tolist()).decode("ascii")


def test_colliding_hashes_remove_nothing_that_differs(frame, monkeypatch):
    a, b = collision()
    flat = np.frombuffer((a + b).encode(), np.uint8)
    hashes, at, most = PrefixHash(flat, 1), np.array([0, 164]), np.array([164, 164])
    h = hashes.equal_length(at, most)
    assert len(a) == len(b) == 164 and a != b and h[0] == h[1]
    assert not suffixes.classes(flat, hashes, at, np.zeros(2, int), most)[1].any()
    assert sum(alike(frame, [(1, a), (2, b)]).values()) == 0
    # hashes of four bits collide everywhere: the bytes must still decide
    real = PrefixHash.equal_length
    monkeypatch.setattr(PrefixHash, "equal_length", lambda self, x, n: real(self, x, n) & np.uint64(15))
    rng = random.Random(8)
    data = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(300)]
    flat = np.frombuffer(b"".join(data), np.uint8)
    segment = np.repeat(np.arange(3), 100)
    order, equal = suffixes.classes(flat, PrefixHash(flat), np.arange(300) * 12, segment, np.full(300, 12))
    for k in range(3):
        own = [data[i] for i in order[k * 100 : k * 100 + 100]]
        assert own == sorted(own) and [False, *(x == y for x, y in zip(own, own[1:]))] == equal[k * 100 : k * 100 + 100].tolist()


def test_suffix_dedup_on_extreme_ids(frame):
    t = "a passage that stands twice in this table and is a little longer than the hundred bytes that a window has, so it is cut"
    assert alike(frame, [(2**62 + 5, t), (2**62 + 3, "x " + t), (-(2**63), t + " y"), (2**63 - 1, t)])[2**62 + 5] == len(t)
    rows = suffixes.digests(frame([(2**62, t), (2**62, t), (2**62 + 1, t), (-(2**63), t + "!"), (None, "? " + t)])).collect()
    assert sorted((str(r.doc_id), r.n_removed > 0) for r in rows) == sorted([(str(2**62), True), (str(2**62), True), (str(2**62 + 1), True), (str(-(2**63)), True), ("None", False)])


def test_texts_are_cut_inside(frame, monkeypatch):
    """A text far longer than a slice, whose second half repeats the first; groups of a few blocks; buckets of a few rows."""
    monkeypatch.setattr(suffixes, "HELD", 5000)
    rng = random.Random(9)
    half = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=3 << 20))
    rows = {r.doc_id: r for r in suffixes.digests(frame([(1, half + half), (2, half[1000:300_000]), (3, "".join(rng.choices("abc", k=900)))])).collect()}
    assert (rows[1].n_removed, rows[1].n_spans, rows[1].kept_sha256) == (len(half), 1, hashlib.sha256(half.encode()).hexdigest())
    assert rows[2].n_removed == 299_000 and rows[3].n_removed == 0


@pytest.mark.parametrize(("hot", "batch"), [(2, 10_000), (3, 7)])
def test_frequent_anchors_are_split(spark, frame, monkeypatch, hot, batch):
    monkeypatch.setattr(suffixes, "HOT", hot)
    monkeypatch.setattr(suffixes, "SLICE", 700)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    rng = random.Random(10)
    line = "this line of boilerplate is found in every document of the table, word for word, as licences and footers often are everywhere"
    docs = [(i, f"{rng.random()} {line[: rng.choice((90, 110, 126))]}{rng.random()} {line * rng.choice((0, 1, 3))}") for i in range(80)]
    try:
        assert sum(alike(frame, docs).values()) > 5000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_suffix_sort_orders_suffixes():
    rng = random.Random(2)
    flat = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(3000)), np.uint8)
    at = np.array(sorted(rng.sample(range(2900), 400)))
    segment = np.repeat(np.arange(8), 50)
    most = np.repeat(np.arange(93, 101), 50)
    order = suffixes.suffix_sort(flat, PrefixHash(flat), at, segment, most)
    raw = flat.tobytes()
    for s in range(8):
        own = [raw[a : a + 93 + s] for a in at[order[s * 50 : s * 50 + 50]]]
        assert own == sorted(own)


def plain_fingerprint(t):
    w = (t or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    bits = [sum(xxhash.xxh64_intdigest(s, 42) >> i & 1 for s in shingles) for i in range(64)]
    return sum(1 << i for i, c in enumerate(bits) if 2 * c > len(shingles))


@pytest.mark.parametrize("tile", [16_384, 7])
def test_simhash_against_brute_force(frame, odd, tile, monkeypatch):
    monkeypatch.setattr(simhash.links, "__defaults__", (3, tile))
    docs = odd + [(i + 100, t) for i, t in corpus(3)]
    fp = [plain_fingerprint(t) for _, t in docs]
    label = list(range(len(docs)))
    for _ in docs:
        for i in range(len(docs)):
            for j in range(len(docs)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
    first = {}
    for (i, _), c in zip(docs, label):
        if i is not None:
            first[c] = min(first.get(c, i), i)
    want = sorted(((i, f"{f:016x}", first.get(c)) for (i, _), f, c in zip(docs, fp, label)), key=str)
    assert sorted(map(tuple, simhash.near_duplicates(frame(docs)).collect()), key=str) == want
    assert simhash.near_duplicates(frame([])).count() == 0


def test_tile_links_connect_what_is_near():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 400)] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    fps = np.unique(np.concatenate((base, near)))
    u, v = simhash.tile_links(fps, fps, 3)
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= 3)
    want = simhash.labels_of(len(fps), i, j)
    got = simhash.labels_of(len(fps), np.searchsorted(fps, u), np.searchsorted(fps, v))
    assert np.array_equal(want, got) and len(u) < len(fps)
