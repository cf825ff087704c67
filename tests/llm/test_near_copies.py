import random
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline
from alpenglow.llm import near_copies, shares, simhash, tallies


def shingled(t):
    w = (t or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or {b" ".join(w)}


def labelled(docs):
    """Brute force: the least place in each row's component of pairs of Jaccard similarity 0.8 or more."""
    sets = [shingled(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                label = [min(label[i], label[j]) if c in (label[i], label[j]) else c for c in label]
    return label


def edited(seed, n=40):
    """Texts with copies of which 0 to 6 words are changed, some of copies in turn, and a passage that many share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = " ".join(word() for _ in range(30))
    docs = []
    for _ in range(n):
        w = [word() for _ in range(rng.choice((3, 8, 40, 120, 200)))]
        for _ in range(rng.randint(1, 4)):
            docs.append(" ".join(w))
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
        if rng.random() < 0.5:
            docs.append(f"{' '.join(w)} {passage}")
    return [(k + 100, t) for k, t in enumerate(docs)]


@pytest.mark.parametrize("bucket, share, frequent", [(500_000, 2048, 16), (50, 2048, 2), (50, 3, 2)])
def test_near_copies_against_brute_force(frame, odd, bucket, share, frequent, monkeypatch):
    """Also with tiny buckets, and with groups of more than three texts dealt in shares."""
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    monkeypatch.setattr(near_copies, "FREQUENT", frequent)
    monkeypatch.setattr(shares, "SHARE", share)
    docs = odd + edited(1)
    want = {}
    for (i, t), c in zip(docs, labelled(docs)):
        want.setdefault(c, []).append(i)
    got = {}
    for r in near_copies.near_copies(frame(docs)).collect():
        got.setdefault(r.component, []).append(r.doc_id)
    key = lambda groups: sorted(sorted(map(str, g)) for g in groups.values())
    assert key(got) == key(want) and sum(len(g) > 1 for g in want.values()) > 10
    assert near_copies.near_copies(frame([])).count() == 0


def test_stage_drops_edited_copies(spark, frame):
    docs = edited(2)
    label = labelled(docs)
    left = {r.doc_id for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame(docs), "").collect()}
    assert left == {docs[c][0] for c in label} and len(left) < len(docs)


def test_stage_keeps_texts_that_share_a_doc_id(spark, frame):
    """A component gives one row: ids with several texts, null ids and repeated rows included."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = [(3, a), (5, a + " end"), (5, b), (6, None), (6, "clean text"), (None, c), (None, c), (None, c + " end"), (None, b), (7, "twice"), (7, "twice")]
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.keep_one_of_near_duplicates(spark, frame(docs), "").collect()), key=str)
    assert [x for x in left if x[0] is not None] == sorted([(3, a), (5, b), (6, "clean text"), (6, None), (7, "twice")], key=str)
    assert [t[:5] for i, t in left if i is None] == [c[:5]]


def test_prefixes_of_similar_sets_meet():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        pool = np.unique(rng.integers(0, 1 << 60, 2 * n, dtype=np.uint64))
        a = np.sort(rng.choice(pool, min(n, len(pool)), replace=False))
        b = np.unique(np.r_[a[rng.random(len(a)) < 0.92], rng.choice(pool, n // 12)])
        texts = rng.integers(0, 5, len(pool)) * rng.integers(0, 2)  # all 0: none is frequent
        first = lambda s: s[near_copies.prefix(s, texts[np.searchsorted(pool, s)])]  # noqa: B023, E731
        meet = len(np.intersect1d(first(a), first(b))) > 0
        assert len(b) == 0 or meet or len(np.intersect1d(a, b)) * 5 < 4 * len(np.union1d(a, b))
        if len(b):
            assert near_copies.similar(a, b) == (len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)))


def test_bitmaps_leave_out_no_similar_pair():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(150):
        a = np.unique(rng.integers(0, 1 << 63, int(rng.choice((1, 5, 60, 127, 129, 250, 520, 3000))), dtype=np.uint64))
        keep = a[rng.random(len(a)) < rng.choice((0.85, 0.95, 1.0))]
        sets += [a, np.unique(np.r_[keep, rng.integers(0, 1 << 63, len(a) // 12, dtype=np.uint64)]) if len(keep) else a]
    size = np.array([len(s) for s in sets])
    words = near_copies.n_words(size)
    flat = np.concatenate([near_copies.bitmap(s) for s in sets])
    at = np.r_[0, np.cumsum(words)[:-1]]
    i, j = np.triu_indices(len(sets), 1)
    close = np.minimum(size[i], size[j]) * 5 >= np.maximum(size[i], size[j]) * 4
    i, j = i[close], j[close]
    may = near_copies.may_be_similar(flat, at, words, size, i, j)
    are = np.array([near_copies.similar(sets[a], sets[b]) for a, b in zip(i, j)])
    assert may[are].all() and are.sum() > 30 and may.sum() < 4 * are.sum()


def test_texts_that_stay_apart_do_not_cost_the_square_of_a_group(monkeypatch):
    """A shingle that 1500 copies share with 20 other texts, whose sets are too unlike any."""
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    sets = [np.unique(np.r_[base[: 400 - k], new(k)]) for k in [5] * 1500 + [150] * 20]
    order = rng.permutation(len(sets))
    sets = [sets[i] for i in order]
    calls, pairs, verified = [0], [0], [0]

    def may(*args, real=near_copies.may_be_similar):
        calls[0] += 1
        pairs[0] += len(args[-1])
        return real(*args)

    def similar(a, b, real=near_copies.similar):
        verified[0] += 1
        return real(a, b)

    monkeypatch.setattr(near_copies, "may_be_similar", may)
    monkeypatch.setattr(near_copies, "similar", similar)
    n = len(sets)
    size = np.array([len(s) for s in sets])
    bits = lambda ids, _: np.concatenate([near_copies.bitmap(sets[i]) for i in ids.tolist()])
    u, v = near_copies.bucket_links(np.full(n, base[0]), np.arange(n), size, np.arange(n), lambda i: sets[i], bits)
    far = np.flatnonzero(order >= 1500)
    assert len(u) == 1499 and len(set(v)) == 1 and not np.isin(far, np.r_[u, v]).any()
    assert calls[0] < 12 and pairs[0] < 60 * n and verified[0] < 5 * n
    near = np.flatnonzero(order < 1500)
    root = np.arange(n)
    root[near] = near.min()  # known already: nothing is left to link, whatever the texts apart
    verified[0] = 0
    u, v = near_copies.bucket_links(np.full(n, base[0]), np.arange(n), size, root, lambda i: sets[i], bits)
    assert len(u) == 0 and verified[0] < n


def test_fingerprints_link_before_shingles(frame, monkeypatch):
    """SimHash is a step: fingerprints of all texts go through operator 3's tiles, and what they bring together and sets confirm is linked by them."""
    rng = random.Random(4)
    docs = edited(3, 15)
    for k in range(6):
        w = [f"v{rng.randrange(5000)}" for _ in range(1500)]
        docs += [(900 + 10 * k, " ".join(w)), (901 + 10 * k, " ".join(w).upper()), (902 + 10 * k, " ".join(w[:700] + ["new"] + w[701:]))]
    asked, found = [], []

    def links(fps, radius, real=simhash.links):
        asked.append(({r.fp for r in fps.collect()}, radius))
        return real(fps, radius)

    def components(edges, real=near_copies.components):
        out = real(edges)
        found.append({r[0]: r[1] for r in out.collect()})
        return out

    monkeypatch.setattr(near_copies.simhash, "links", links)
    monkeypatch.setattr(near_copies, "components", components)
    assert near_copies.near_copies(frame(docs)).count() == len(docs)
    texts = sorted({t for _, t in docs})
    fps = [simhash.fingerprint(t.encode(), 5) for t in texts]
    assert asked == [({f - (1 << 64) if f >> 63 else f for f in fps}, 3)]
    sets = [shingled(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and (fps[i] ^ fps[j]).bit_count() <= 3 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [min(label[i], label[j]) if c in (label[i], label[j]) else c for c in label]
    least = len(texts) - len(set(label))  # links that fingerprints and sets give; chains may bring more together
    by_fingerprints = found[1]
    assert len(by_fingerprints) - len(set(by_fingerprints.values())) >= least >= 8


def test_removed_sets_give_their_disk_space_back(frame):
    """No worker still maps the files of sets and bitmaps once the stage has removed them."""
    assert near_copies.one_of_each(frame(edited(6))).count() > 0
    mapped = []
    for maps in Path("/proc").glob("[0-9]*/maps"):
        try:
            mapped += [x for x in maps.read_text().splitlines() if "/shingles-" in x and x.endswith("(deleted)")]
        except OSError:
            pass
    assert not mapped


def test_tallies_of_shingles(spark, tmp_path):
    """Blocks of sets learn in how many texts of all blocks their shingles come."""
    rng = np.random.default_rng(8)
    pool = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    rows, held, texts = [], {}, {}
    for block in range(4):
        sets = [np.unique(rng.choice(pool[: 20 if block else 60], int(rng.integers(1, 15)))) for _ in range(10)]
        at = np.r_[0, np.cumsum([len(s) for s in sets])]
        np.save(tmp_path / f"{block}.npy", np.concatenate(sets))
        rows += [((block << 28) + int(x), len(s)) for x, s in zip(at, sets)]
        held[block] = np.unique(np.concatenate(sets))
        for s in sets:
            for x in s.tolist():
                texts[x] = texts.get(x, 0) + 1
    each = spark.createDataFrame(rows, "node long, size long").repartition(3, (near_copies.F.shiftright("node", 28))).sortWithinPartitions("node")
    assert tallies.tally(each, str(tmp_path), 28, 5, 3) == max(texts.values())
    for block, s in held.items():
        got = tallies.counts(s, np.load(tmp_path / f"{block}-often.npy"), 5)
        assert got.tolist() == [texts[x] if texts[x] >= 3 else 0 for x in s.tolist()]
    assert tallies.tally(each.limit(0), str(tmp_path), 28, 5, 3) == 0


def test_unlike_texts_under_one_shingle_are_dealt_over_tasks(spark, tmp_path):
    """5,000 sets share a shingle: copies of one, which the first rounds link, and others; of these no task meets more than two shares."""
    rng = np.random.default_rng(9)
    new = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    base, far, hot = new(60), [], new(1)
    sets = [np.r_[hot, base[:-2], new(2)] for _ in range(1500)] + [np.r_[hot, new(int(k))] for k in rng.choice((30, 60, 61, 200), 3480)]
    for _ in range(10):  # pairs of near copies among the others
        far.append(len(sets))
        sets += [x := np.r_[hot, new(80)], np.r_[x[:-3], new(3)]]
    sets = [np.unique(s) for s in sets]
    at = np.r_[0, np.cumsum([len(s) for s in sets])].tolist()
    np.save(tmp_path / "sets.npy", np.concatenate(sets))
    rows = spark.createDataFrame([(7, k, len(s), k) for k, s in enumerate(sets)], "token long, node long, size long, root long").repartition(8)
    folder = str(tmp_path)

    def compare(token, node, size, root, asked):
        import os

        flat = np.load(f"{folder}/sets.npy", mmap_mode="r")
        read = lambda k: np.asarray(flat[at[k] : at[k + 1]])
        u, v = near_copies.bucket_links(token, node, size, root, read, lambda ids, _: np.concatenate([near_copies.bitmap(read(k)) for k in ids.tolist()]), asked)
        with open(f"{folder}/tasks", "a") as log:
            log.write(f"{len(np.unique(node))} {asked is not None} {os.getpid()}\n")
        return near_copies.pa.table({"u": near_copies.pa.array(u, near_copies.pa.int64()), "v": near_copies.pa.array(v, near_copies.pa.int64())})

    found = shares.links(rows, spark.createDataFrame([], shares.LINKS), compare)
    root = {r.node: r.root for r in shares.components(found).collect()}
    assert len(root) == 1520 and {root[k] for k in range(1500)} == {0}
    assert all(root[k] == root[k + 1] == k for k in far)
    tasks = [(int(n), asked == "True") for n, asked, _ in (x.split() for x in (tmp_path / "tasks").read_text().splitlines())]
    assert max(n for n, _ in tasks) < 2.2 * shares.SHARE  # shares are even, but by hash
    assert sum(asked for _, asked in tasks) >= 8  # cells by size and share, of 5,000 rows; each of bounded work
