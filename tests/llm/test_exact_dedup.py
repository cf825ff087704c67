import hashlib
import random
import re

import pytest

from alpenglow.llm import exact_dedup
from alpenglow.llm.exact_dedup import Trie
from alpenglow.llm.queries import SQL


def plain(rows):
    """(id, keep_id, group_size, kept, sha256) of rows with distinct ids."""
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    least = lambda ids: min((i for i in ids if i is not None), default=None)
    return sorted(((i, least(groups[t]), len(groups[t]), i == least(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm), key=repr)


def corpus(n=400):
    rng = random.Random(11)
    base = ["", " ", None, "ab", "abc", "abd", "b" * 5000, "b" * 5000 + "c", "日本 語", "日本\t\n語", "\x0b\x0c", "a\x00b", "same prefix " * 40, "same prefix " * 40 + "and more"]
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 3)))
    base += [rng.choice([" ", "\t \r"]).join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    return [(i, "copies of one" if rng.random() < 0.35 else rng.choice(base)) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("local,owner", [(16 << 20, 64 << 20), (1, 1), (2000, 3000)])
def test_groups_against_brute_force(frame, monkeypatch, local, owner):
    """Also with tries that give away subtrees round after round."""
    monkeypatch.setattr(exact_dedup, "LOCAL", local)
    monkeypatch.setattr(exact_dedup, "OWNER", owner)
    rows = corpus(120 if local == 1 else 400)
    got = exact_dedup.groups(frame(rows).repartition(3))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_spilled_subtrees_hold_whole_prefixes():
    rng = random.Random(3)
    keys = list({bytes(rng.choice(b"xyz") for _ in range(rng.randint(0, 9))) for _ in range(600)})
    trie, end = Trie(), {}
    for k in keys[:300]:
        end[k] = trie.insert(k)
    assert len(set(end.values())) == 300 and all(trie.insert(k) == e for k, e in end.items())
    gone = {}
    while spilled := trie.spill():
        number, subtree = spilled
        assert subtree and all(end[k] == e for k, e in subtree)
        gone |= {k: number for k, _ in subtree}
    assert len(gone) == 299  # one string stays
    assert all(trie.insert(k) == (~gone[k] if k in gone else end[k]) for k in end)
    for k in keys[300:]:  # a new string waits exactly where its prefix was given away
        at = trie.insert(k)
        assert at >= 0 or any(g[:1] == k[:1] for g, n in gone.items() if n == ~at)


def test_odd_rows(spark, frame, odd):
    got = exact_dedup.groups(frame(odd)).collect()
    assert len(got) == len(odd)
    empty = [r for r in got if r.text_sha256 == hashlib.sha256(b"").hexdigest()]
    assert sorted(r.doc_id for r in empty) == [1, 2] and all(r.keep_id == 1 and r.group_size == 2 for r in empty)
    twice = [r for r in got if r.doc_id == 7]
    assert [r.keep_id for r in twice] == [7, 7] and sorted(r.kept for r in twice) == [False, True]
    alone = [r for r in got if r.doc_id is None]
    assert alone[0].keep_id is None and alone[0].kept
    assert exact_dedup.groups(frame([])).count() == 0
    same = exact_dedup.groups(frame([(None, "x"), (None, "x"), (5, "x")])).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in same} == {(None, 5, False), (5, 5, True)}


def test_one_of_each_keeps_all_columns(spark):
    names = ["doc_id", "text", "part", "row", "node", "n", "low", "kept", "rest", "id"]
    df = spark.createDataFrame([(k, t, *range(8)) for k, t in [(3, "a b"), (1, "a\tb"), (2, "c")]], names)
    got = exact_dedup.one_of_each(df)
    assert got.columns == names and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, "a\tb"), (2, "c")]


def test_sql_is_registered():
    assert "op11_exact_dedup" in SQL
