import hashlib
import random
import zlib

import numpy as np
import pytest

from alpenglow.llm import packing, pieces, token_counts, words
from alpenglow.llm.packing import OpenBins

LETTERS = "abcdefghij klmnop ABC éñß,.'-_/0123\n=+日本'sreve"


def texts(seed, n=120):
    rng = random.Random(seed)
    made = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 300))) for _ in range(n)]
    return [*made, "", " ", "  a  b ", "ab" * 900, "a" * 700, "'s 'll x''ve", "<s> </s> <unk> <0x41>", "İstanbul ǅ", "<|startoftext|>x"]


@pytest.fixture(scope="module")
def library(piece_model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model)


def test_pieces_equal_the_library(piece_model, library):
    docs, codec = texts(1), pieces.codec(piece_model)
    ids, at = codec.encode([d.encode() for d in docs])
    got = [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert got == library.encode(docs)
    assert [codec.decode(np.array(x + [2], np.int64)) for x in got] == [library.decode(x + [2]) for x in got]


def test_any_ids_decode_like_the_library(piece_model, library):
    rng, codec = random.Random(2), pieces.codec(piece_model)
    for _ in range(400):
        ids = [rng.choice((rng.randrange(32000), rng.randrange(3, 259))) for _ in range(rng.randint(0, 10))]
        assert codec.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_words_equal_the_library(word_model):
    docs, codec = texts(3), words.codec(word_model)
    ids, at = codec.encode([d.encode() for d in docs])
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [codec.library.encode(d, add_special_tokens=False).ids for d in docs]


def test_piece_queries_on_odd_rows(frame, odd, piece_model, library):
    got = pieces.digests(frame(odd), piece_model).collect()
    want = []
    for i, t in odd:
        ids = library.encode(t or "") + [2]
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    rows = pieces.encode(frame(odd), piece_model).collect()
    assert {r.doc_id: r.decoded for r in rows}[4] == "word"
    assert pieces.digests(frame([]), piece_model).count() == 0


def test_counts_and_their_cache(spark, frame, odd, piece_model, library, tmp_path):
    cache = f"file://{tmp_path}/cache"
    got = token_counts.count(frame(odd), piece_model, cache, limit=100).collect()
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 100) for i, t in odd]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = spark.read.parquet(cache)
    assert kept.count() == len({t or "" for _, t in odd})
    token_counts.count(frame([(50, "word"), (51, "new words")]), piece_model, cache).collect()
    assert spark.read.parquet(cache).count() == len({t or "" for _, t in odd}) + 1
    assert token_counts.count(frame([]), piece_model, f"file://{tmp_path}/none").count() == 0


def test_packing_is_whole_and_dense(frame, odd, word_model):
    rng = random.Random(4)
    docs = odd + [(100 + k, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) for _ in range(rng.randint(1, 60)))) for k in range(300)]
    rows = packing.pack(frame(docs), word_model, size=64, open_bins=32).collect()
    codec = words.codec(word_model)
    want = []
    for i, t in docs:
        ids = codec.library.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, a, len(x := ids[a : a + 64]), zlib.crc32(np.array(x, "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 64))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in bins.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.05 * sum(r.length for r in rows) / 64 + 32
    assert packing.pack(frame([]), word_model).count() == 0


def test_open_bins_against_a_plain_version():
    rng, bins, plain, made = random.Random(5), OpenBins(50, 4), [], 0
    for _ in range(500):
        n = rng.randint(1, 50)
        fits = [f for f, _ in plain if f >= n]
        bin_, offset = bins.put(n)
        if fits:
            best = min(fits)
            assert offset == 50 - best and (best, bin_) in plain
            plain.remove((best, bin_))
        else:
            best = 50
            assert bin_ == made and offset == 0
            made += 1
            if len(plain) == 4:
                plain.remove(min(plain, key=lambda x: (x[0], -plain.index(x))))
        if best - n:
            plain.append((best - n, bin_))
        assert sorted(f for f, _ in plain) == sorted(f for f, b in bins.by_free.items() for _ in b)
