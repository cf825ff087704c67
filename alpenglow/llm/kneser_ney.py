"""Operator 7: an interpolated modified Kneser-Ney model, counted in Spark, kept as sorted hash arrays.

Words are hashed to 64 bits, and their bytes kept beside the hashes, so that words of one hash stay
apart. A word's id is its rank among all training words in the order of hash and bytes. An n-gram is
a pair of (n-1)-grams, those without its last and without its first word, and is hashed by the pair
of their ids, without collisions up to 2^32 of these; its own id is its rank in the order of hashes.
So every order is counted as the one before it, and takes the same eight bytes to send. All hashes
are evenly spread, so parts by their leading bits are even whatever words are frequent. Counts travel
packed, an array for each part and batch, and end as sorted arrays in files of the shared folder,
which the scoring workers map into memory.

Below the highest order an n-gram counts by the distinct words before it; those that begin a text,
which have none, count by their occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import files, shared
from alpenglow.llm.bpe import unique_words
from alpenglow.llm.vector import MASK, PrefixHash, eights, heads, mix, offsets, ordered, pack, part_of, ragged, same_spans, segment_sum, texts, unmix, unpack

#: Text bytes for one part of the model.
PART_BYTES = 6 << 20
#: Bytes of a block of text: a block's n-grams are looked up once each, so larger ones than elsewhere save time.
TEXT = 2 << 20
#: Files of a column at most: their number is what a block of text that is looked up has to go through.
FILES = 64
#: Parts, where there are more than FILES, that statistics are sent to together: every part sends a row to every such group.
GROUP = 4
#: Words, and pairs of words, that a task gathers before it sends them on.
WORDS, PAIRS = 400_000, 800_000
#: Words of the longest n-grams, where nothing else is asked for.
ORDER = 3
FOLDS, HELD_OUT = 7, 2
END = np.uint64(0x5851F42D4C957F2D)
#: Bytes of the words that are told apart by their hashes alone, and of those that are hashed without sums over their bytes.
EXACT, SHORT = 7, 16
PACKED = "part int, kind int, data binary"


@dataclass
class Tokens:
    """Words in ``flat``, each text's end (of length 0) after its last: hashes, places, and the texts' bounds ``at``."""

    flat: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    length: np.ndarray
    at: np.ndarray


def word_hashes(chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of words: of up to EXACT bytes different ones for different words; long ones by :class:`PrefixHash`."""
    eight = eights(chars)
    h = mix((eight[start] & MASK[np.minimum(length, EXACT)]) | (length.astype(np.uint64) << np.uint64(56)))
    more = np.flatnonzero(length > EXACT)
    if len(more):
        a, n = start[more], length[more]
        h[more] = mix((mix(eight[a]) ^ eight[a + n - 8]) + END * n.astype(np.uint64))
    long = more[length[more] > SHORT]
    if len(long):
        n = length[long]
        at = offsets(n)
        h[long] = PrefixHash(chars[ragged(start[long], n)]).span(at[:-1], at[1:])
    return h


def tokens(docs: list[bytes]) -> Tokens:
    flat = np.frombuffer(b"\n".join([b"", *docs, b""]).lower(), np.uint8)
    white = (flat - np.uint8(0x09) < 5) | (flat == 0x20)
    edge = np.flatnonzero(white[1:] != white[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    doc_at = 1 + offsets(np.array([len(d) + 1 for d in docs]))
    at = offsets(np.diff(np.searchsorted(start, doc_at)) + 1)
    is_word = np.ones(at[-1], bool)
    is_word[at[1:] - 1] = False
    out = Tokens(flat, np.full(at[-1], END), np.zeros(at[-1], np.int64), np.zeros(at[-1], np.int64), at)
    out.hash[is_word], out.start[is_word], out.length[is_word] = word_hashes(flat, start, end - start), start, end - start
    return out


def distinct(chars: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct word, in the order of hash and bytes, and for every word its place among these."""
    first, inverse, n = unique_words(chars, start, length, hashes, EXACT)
    if len(first) == n:
        return first, inverse
    # some words have one hash: these are told apart, and ordered, by their bytes
    shared_ = np.isin(hashes[first], hashes[first[n:]])
    word = [(int(hashes[i]), chars[start[i] : start[i] + length[i]].tobytes() if s else b"") for i, s in zip(first.tolist(), shared_.tolist())]
    place = {w: k for k, w in enumerate(sorted(set(word)))}
    to = np.array([place[w] for w in word], np.int64)
    rep = np.zeros(len(place), np.int64)
    rep[to[::-1]] = first[::-1]
    return rep, to[inverse]


def summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys (none negative) in order and the sums of their values (int64)."""
    order, in_order = ordered(keys)
    head = heads(in_order)
    ends = np.append(head, len(keys))
    return [in_order[head].astype(keys.dtype, copy=False), *(np.diff(offsets(v[order])[ends]) for v in values)]


def occurrences(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each of them comes."""
    keys = np.sort(keys)
    head = heads(keys)
    return keys[head], np.diff(head, append=len(keys))


def summed_pairs(before: np.ndarray, own: np.ndarray, count: np.ndarray | None = None) -> list[np.ndarray]:
    """Distinct pairs of ids in order, and the sums of their counts (none given: of ones)."""
    if max(before.max(initial=0), own.max(initial=0)) < 1 << 32:  # one key orders them
        pair = (before.astype(np.uint64) << np.uint64(32)) | own.astype(np.uint64)
        if count is None:
            pair, count = occurrences(pair)
        else:  # mostly of some sorted runs, which a stable sort merges
            order = np.argsort(pair, kind="stable")
            pair = pair[order]
            head = heads(pair)
            pair, count = pair[head], np.diff(offsets(count[order])[np.append(head, len(order))])
        return [(pair >> np.uint64(32)).view(np.int64), (pair & np.uint64(0xFFFFFFFF)).view(np.int64), count]
    count = np.ones(len(own), np.int64) if count is None else count
    order = np.lexsort((own, before))
    before, own, count = before[order], own[order], count[order]
    head = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (own[1:] != own[:-1])][: len(own)])
    return [before[head], own[head], np.add.reduceat(count.astype(np.int64), head) if len(head) else count]


def pair_hash(before: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Hashes of pairs of ids; without collisions where both are below 2^32."""
    b = before.astype(np.uint64)
    return mix(((b << np.uint64(32)) | (b >> np.uint64(32))) ^ own.astype(np.uint64))


def hashed_pair(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids, both below 2^32, whose :func:`pair_hash` is ``h``."""
    both = unmix(h)
    return (both >> np.uint64(32)).view(np.int64), (both & np.uint64(0xFFFFFFFF)).view(np.int64)


def sealed(ids: np.ndarray, *values: np.ndarray) -> bytes:
    """Arrays of one length, the first ascending: its steps and the rest as byte planes, compressed."""
    steps = ids.copy()
    steps[1:] -= ids[:-1]
    data = pack(steps, *values)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def opened(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of :func:`sealed`, of these types."""
    steps, *values = unpack(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True), *kinds)
    return [np.cumsum(steps, dtype=steps.dtype), *values]


def _rows(part: np.ndarray, kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One packed row for each part; ``part`` ascends."""
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    ends = np.r_[cut[1:], len(part)].astype(np.int64)
    data = [sealed(*(v[a:b] for v in columns)) for a, b in zip(cut.tolist(), ends.tolist())]
    return _sent(part[cut], kind, data)


def _sent(part: np.ndarray, kind: int, data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(part).astype(np.int32)), pa.array(np.full(len(data), kind, np.int32)), pa.array(data, pa.binary())], names=["part", "kind", "data"])


def _gathered(batches: Iterator[pa.RecordBatch], entries, merged, packed, most: int) -> Iterator[pa.RecordBatch]:
    """``entries(texts)`` of every block, merged whenever there are ``most``, and ``packed`` where that doesn't halve them."""
    held: list = []
    n = 0
    for _, raw in texts(batches, size=TEXT):
        held.append(entries(raw))
        n += len(held[-1][0])
        if n > most:
            held = [merged(held)]
            n = len(held[0][0])
            if n > most // 2:
                yield packed(held[0])
                held, n = [], 0
    if held:
        yield packed(merged(held))


def _word_counts(raw: list[bytes]) -> tuple[np.ndarray, ...]:
    """Distinct words of some texts: hash, count, length, and all their bytes."""
    t = tokens(raw)
    rep, inverse = distinct(t.flat, t.start, t.length, t.hash)
    return t.hash[rep], np.bincount(inverse, minlength=len(rep)), t.length[rep], t.flat[ragged(t.start[rep], t.length[rep])]


def _merged_words(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    h, count, length, chars = (np.concatenate(x) for x in zip(*held))
    start = offsets(length)[:-1]
    rep, inverse = distinct(chars, start, length, h)
    total = np.zeros(len(rep), np.int64)
    np.add.at(total, inverse, count)
    return h[rep], total, length[rep], chars[ragged(start[rep], length[rep])]


WORD = ("<u8", "<u4", "<u4")  # hash, count, length


@dataclass
class SortedParts:
    """Arrays of one name in files, sorted over all parts; ``sizes`` has each part's length.

    Parts are what one task makes, and grow in number with the text; a file holds one part, or, beyond FILES
    of these, some that follow each other, as what is looked up costs a step for each file.
    """

    folder: str
    name: str
    sizes: list[int]

    def __post_init__(self):
        self.at = offsets(np.array(self.sizes))
        n = min(FILES, len(self.sizes))
        self.first = np.arange(n + 1) * len(self.sizes) // n  # each file's first part
        self.file_at = self.at[self.first]
        k = -(-len(self.sizes) // (GROUP if len(self.sizes) > FILES else 1))
        self.group = np.arange(k + 1) * len(self.sizes) // k  # each group's first part

    def path(self, column: str, file: int) -> str:
        return f"{self.folder}/{self.name}-{column}-{file:06d}.npy"

    def column(self, column: str, file: int) -> np.ndarray:
        return np.asarray(files.load(self.path(column, file)))  # not a memmap: whose slices take longer

    def size(self, file: int) -> int:
        return int(self.file_at[file + 1] - self.file_at[file])

    def place(self, part: int) -> tuple[int, slice]:
        """A part's file and place there."""
        file = int(np.searchsorted(self.first, part, "right")) - 1
        return file, slice(int(self.at[part] - self.file_at[file]), int(self.at[part + 1] - self.file_at[file]))

    def files_of(self, needles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(file, from, to) of sorted hashes, without empty files."""
        file = np.searchsorted(self.first, part_of(needles, len(self.sizes)).astype(np.int64), "right") - 1
        return (x for x in _cuts(file) if self.size(x[0]))

    def find(self, needles: np.ndarray) -> np.ndarray:
        """Ranks of sorted hashes, -1 where absent."""
        out = np.full(len(needles), -1, np.int64)
        for f, a, b in self.files_of(needles):
            have = self.column("hash", f)
            k = np.minimum(np.searchsorted(have, needles[a:b]), len(have) - 1)
            out[a:b] = np.where(have[k] == needles[a:b], self.file_at[f] + k, -1)
        return out

    def find_words(self, needles: np.ndarray, chars: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Ranks of words in the order of their hashes, -1 where absent; their bytes are compared, not only the hashes."""
        out = np.full(len(needles), -1, np.int64)
        for f, a, b in self.files_of(needles):
            have, at, kept = (self.column(c, f) for c in ("hash", "at", "chars"))
            todo, k = np.arange(a, b), np.searchsorted(have, needles[a:b])
            while len(todo):  # once but for words of one hash
                ok = k < len(have)
                ok[ok] = have[k[ok]] == needles[todo[ok]]
                todo, k = todo[ok], k[ok]
                begin = at[k]
                same = at[k + 1] - begin == length[todo]
                i = np.flatnonzero(same & (length[todo] > EXACT))
                size = length[todo[i]]
                own = offsets(size)[:-1]
                same[i] = same_spans(chars[ragged(start[todo[i]], size)], own, kept[ragged(begin[i], size)], own, size)
                out[todo[same]] = self.file_at[f] + k[same]
                todo, k = todo[~same], k[~same] + 1
        return out

    def take(self, column: str, ranks: np.ndarray) -> np.ndarray:
        """Values at any ranks; -1 gives 0."""
        return self.take_all(ranks, column)[0]

    def take_all(self, ranks: np.ndarray, *columns: str) -> list[np.ndarray]:
        """:meth:`take` of some columns, the ranks put in order once, if they are not."""
        out = [np.zeros(len(ranks), np.int64) for _ in columns]
        order = np.flatnonzero(ranks >= 0)
        sorted_ = ranks[order]
        if (sorted_[1:] < sorted_[:-1]).any():
            order = order[np.argsort(sorted_)]
            sorted_ = ranks[order]
        for f, a, b in _cuts(np.searchsorted(self.file_at, sorted_, "right") - 1):
            for values, c in zip(out, columns):
                values[order[a:b]] = self.counts(c, f, sorted_[a:b] - self.file_at[f])
        return out

    def counts(self, column: str, file: int, places: np.ndarray | None = None) -> np.ndarray:
        """The numbers that :func:`short` made bytes of, all of a file or those at some places."""
        have, n = self.column(column, file), self.size(file)
        places = np.arange(n) if places is None else places
        out = have[places].astype(np.int64)
        big = np.flatnonzero(out == 255)
        if len(big):
            at, value = np.frombuffer(have[n:].tobytes(), "<i8").reshape(2, -1)
            out[big] = value[np.searchsorted(at, places[big])]
        return out

    def part_path(self, column: str, part: int) -> str:
        """Where the task that makes a part puts it: its file, or what :meth:`join` makes files of."""
        return self.path(column, part) if len(self.sizes) <= FILES else self.path(f"{column}-part", part)

    def join(self, file: int, *columns: str) -> None:
        """A file of its parts, which are removed; a task that runs again leaves what is done."""
        parts = [p for p in range(self.first[file], self.first[file + 1]) if self.sizes[p]]
        for c in columns if parts else ():
            paths = [self.part_path(c, p) for p in parts]
            if not files.there(self.path(c, file)):
                files.save_joined(self.path(c, file), *_joined(c, [files.opened(x) for x in paths], [self.sizes[p] for p in parts]))
            for x in paths:
                files.remove(x)


def _joined(column: str, arrays: list[np.ndarray], sizes: list[int]) -> tuple[np.dtype, int, Iterator[np.ndarray]]:
    """Type, length and pieces of the array that some parts' arrays make."""
    if column in ("hash", "before", "own", "chars"):
        return arrays[0].dtype, sum(map(len, arrays)), iter(arrays)
    if column == "at":
        shift = offsets(np.array([x[-1] for x in arrays]))
        return arrays[0].dtype, sum(sizes) + 1, (x[bool(k) :] + shift[k] for k, x in enumerate(arrays))
    # bytes of numbers, then the places and values of the large ones
    large = [np.frombuffer(x[n:].tobytes(), "<i8").reshape(2, -1) + np.array([[at], [0]]) for x, n, at in zip(arrays, sizes, offsets(np.array(sizes)))]
    tail = np.frombuffer(np.concatenate(large, axis=1).astype("<i8").tobytes(), np.uint8)
    return arrays[0].dtype, sum(sizes) + len(tail), chain((x[:n] for x, n in zip(arrays, sizes)), [tail])


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of the runs of ascending parts."""
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
    yield from zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(part)])


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    each = [k - (k + 1) * y * b / a if a and b else min(k, 1) * 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), each))])


def _discount(d: np.ndarray, count: np.ndarray) -> np.ndarray:
    return d[np.minimum(count, 3)]


@dataclass
class Grams:
    """The n-grams of one length from 2 on, and what the model needs to know of all of them."""

    parts: SortedParts
    counts: str  # the column of the counts that are discounted
    discount: np.ndarray


@dataclass
class Following:
    """The n-grams of one length that end at the tokens of ``place``.

    Ids are told once for all tokens that have them: ``shorter`` has those of the n-grams one shorter, of which each one here is the
    ``before``-th, without its last word, and the ``own``-th, without its first; ``ids`` its own, as the ``index``-th. -1: not in training.
    """

    place: np.ndarray
    shorter: np.ndarray
    before: np.ndarray
    own: np.ndarray
    ids: np.ndarray
    index: np.ndarray


def followed(t: Tokens, ids: np.ndarray, index: np.ndarray, n_words: int, known: list[SortedParts]) -> Iterator[Following]:
    """The n-grams of the lengths 2, 3, ..., one beyond those of ``known`` and of that length without ids, of words whose
    ids are ``ids[index]``. The ids of a length ascend, -1 aside.

    The word before a text's first is its start, ``n_words``, the last of the shorter ids of length 2.
    """
    in_text = np.arange(len(index)) - np.repeat(t.at[:-1], np.diff(t.at))
    first, ids = t.at[:-1], np.append(ids, n_words)
    for k in range(len(known) + 1):
        place = np.flatnonzero(in_text >= k)
        before, own = index[place - 1], index[place]
        if not k:
            before[first] = len(ids) - 1
        found, to = np.full(1, -1, np.int64), np.zeros(len(place), np.int64)
        if k < len(known):
            b, o = ids[before], ids[own]
            both = np.flatnonzero((b >= 0) & (o >= 0))
            order, key = ordered(pair_hash(b[both], o[both]))
            head = heads(key)
            found = np.append(known[k].find(key[head]), -1)
            to[:] = len(head)
            to[both[order]] = np.repeat(np.arange(len(head)), np.diff(head, append=len(key)))
        yield Following(place, ids, before, own, found, to)
        ids, index = found, np.full(len(index), len(found) - 1)
        index[place] = to


@dataclass
class KneserNey:
    """A trained model; its arrays are in the files of ``words`` and ``grams``."""

    words: SortedParts
    grams: list[Grams]  # of two words, of three, ...
    tokens: int  # of the training texts
    starts: list[int]  # words seen first in a text: distinct once, twice, three times or more; texts
    word_discount: np.ndarray
    continued: int  # distinct pairs
    continued_of: list[int]  # words that continue 1, 2, 3 or more distinct words

    @property
    def n_words(self) -> int:
        return int(self.words.at[-1])

    def score(self, docs: list[bytes]) -> dict[str, np.ndarray]:
        """Per text: n_tokens, n_known, base_score and score (log10)."""
        t = tokens(docs)
        h, at = t.hash, t.at
        rep, inverse = distinct(t.flat, t.start, t.length, h)
        rank = self.words.find_words(h[rep], t.flat, t.start[rep], t.length[rep])
        follow = [["n1", "n2", "n3", "count" if g is self.grams[-1] else "total"] for g in self.grams]
        count, cont, *context = self.words.take_all(rank, "count", "cont", *follow[0])
        context = [np.append(x, start) for x, start in zip(context, self.starts)]
        base = np.log10((count + 1) / (self.tokens + (self.n_words + 1)))
        d = self.word_discount
        if self.continued:
            rest = sum(d[k + 1] * self.continued_of[k] for k in range(3)) / self.continued
            lower = np.maximum(cont - _discount(d, cont), 0) / self.continued + rest / (self.n_words + 1)
        else:
            lower = np.full(len(rep), 1.0 / (self.n_words + 1))
        p = lower[inverse]
        for g, x, columns in zip(self.grams, followed(t, rank, inverse, self.n_words, [g.parts for g in self.grams]), [*follow[1:], []]):
            n1, n2, n3, total = context
            seen, *context = g.parts.take_all(x.ids, g.counts, *columns)
            e, out_of = g.discount, np.maximum(total, 1)
            gamma = np.where(n1 + n2 + n3 > 0, (e[1] * n1 + e[2] * n2 + e[3] * n3) / out_of, 1.0)
            kept = np.maximum(seen - _discount(e, seen), 0)  # of none seen nothing
            p[x.place] = kept[x.index] / out_of[x.before] + gamma[x.before] * p[x.place]
        return {"n_tokens": np.diff(at), "n_known": segment_sum((count[inverse] > 0).astype(np.int64), at), "base_score": segment_sum(base[inverse], at), "score": segment_sum(np.log10(p), at)}


def _of_counts(count: np.ndarray) -> list[int]:
    return [int((count == k).sum()) for k in (1, 2, 3, 4)]


def short(x: np.ndarray) -> np.ndarray:
    """Numbers as a byte each; those from 255 on are named after all bytes, their places first."""
    big = np.flatnonzero(x >= 255)
    return np.r_[np.minimum(x, 255).astype(np.uint8), np.frombuffer(big.astype("<i8").tobytes() + x[big].astype("<i8").tobytes(), np.uint8)]


def _statistics(part: int, shorter: SortedParts, before: np.ndarray, own: np.ndarray, counts: np.ndarray, total: bool) -> pa.Table:
    """What a part's n-grams say of those one shorter: kind 1 of what follows them (1, 2, 3 or more times; ``total``: in all),
    kind 2 of how many precede them, both for each group of parts; kind 3: the part's number, its n-grams, and how many of them count 1, 2, 3 and 4."""
    prev = summed(before, counts == 1, counts == 2, counts >= 3, *([counts] if total else []))
    cont = occurrences(own)
    to = lambda ids: np.searchsorted(shorter.at[shorter.group], ids, "right") - 1
    sent = [_rows(to(x[0]), kind, x[0].astype("<i8"), *(v.astype("<u4") for v in x[1:4]), *(v.astype("<u8") for v in x[4:])) for kind, x in ((1, prev), (2, cont))]
    sent.append(_sent([-1], 3, [np.array([part, len(own), *_of_counts(counts)], np.int64).tobytes()]))
    return pa.Table.from_batches(sent)


def _numbers(stats: DataFrame, parts: int) -> tuple[list[int], list[int]]:
    """Each part's size, and how many n-grams of all count 1, 2, 3 and 4: one short row for each part."""
    told = np.array([np.frombuffer(r[0], np.int64) for r in stats.where("kind = 3").select("data").collect()], np.int64).reshape(-1, 6)
    sizes = np.zeros(parts, np.int64)
    sizes[told[:, 0]] = told[:, 1]
    return sizes.tolist(), told[:, 2:].sum(axis=0).tolist()


def _dense(table: pa.Table, base: int, n: int, total: bool) -> dict[str, np.ndarray]:
    """The statistics that were sent to one group of parts, by place in it."""
    dense = {k: np.zeros(n, np.int64) for k in ("n1", "n2", "n3", "cont", *(["total"] if total else []))}
    follows = [k for k in dense if k != "cont"]
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist()):
        if kind:
            names = follows if kind == 1 else ["cont"]
            ids, *values = opened(data, "<i8", *("<i8" if k == "total" else "<u4" for k in names))
            ids -= base
            for name, v in zip(names, values):
                dense[name][ids] += v
    return dense


def train(docs: DataFrame, order: int = ORDER) -> KneserNey:
    """A model of n-grams of up to ``order`` words (2 or more) of all texts of ``docs``.

    Null texts count as empty, and an empty text is its end alone.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    with shared.shuffles_end_with_queries(docs.sparkSession):
        return _train(docs, order)


def _train(docs: DataFrame, order: int) -> KneserNey:
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_docs, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(4, -(-int(size) // PART_BYTES))
    folder = shared.fresh(spark, "kneser-ney")
    grouped = "part int, n long, c1 long, c2 long, c3 long, c4 long, total long"

    def told(part: int, *x: int) -> pa.Table:
        return pa.table({"part": pa.array([part], pa.int32())} | {k: pa.array([int(v)], pa.int64()) for k, v in zip(("n", "c1", "c2", "c3", "c4", "total"), x)})

    def save(name: str, column: str, part: int, array: np.ndarray) -> None:
        files.save(SortedParts(folder, name, [0] * parts).part_path(column, part), array)

    def save_group(made: SortedParts, group: int, arrays: dict[str, np.ndarray]) -> None:
        """Numbers of a group's parts, each part's to its own file."""
        first = made.at[made.group[group]]
        for part in range(made.group[group], made.group[group + 1]):
            if made.sizes[part]:
                for column, x in arrays.items():
                    save(made.name, column, part, short(x[made.at[part] - first : made.at[part + 1] - first]))

    def joined(made: SortedParts, *columns: str) -> SortedParts:
        """The same, its columns' parts joined to files."""
        if parts > FILES:

            def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for file in batch.column(0).to_pylist():
                        made.join(file, *columns)
                    yield batch.slice(0, 0)

            spark.range(0, FILES, 1, FILES).mapInArrow(each, "id long").collect()  # no rows
        return made

    def collected(df: DataFrame, n: int) -> list:
        """One short row for each part of the model: their number is the text's size by PART_BYTES."""
        got = {r["part"]: r for r in df.collect()}
        return [got.get(p) for p in range(n)]

    # words
    def packed_words(words: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        h, count, length, chars = words
        at = offsets(length)
        cuts = list(_cuts(part_of(h, parts)))
        fixed = [pack(*(c[a:b].astype(k) for c, k in zip((h, count, length), WORD))) for _, a, b in cuts]
        return _sent([p for p, *_ in cuts], 0, [x + chars[at[a] : at[b]].tobytes() for x, (_, a, b) in zip(fixed, cuts)])

    def word_part(table: pa.Table) -> pa.Table:
        part, held = table.column("part")[0].as_py(), []
        for data in table.column("data").to_pylist():
            h, count, length = unpack(data, *WORD)
            held.append((h, count.astype(np.int64), length.astype(np.int64), np.frombuffer(data, np.uint8, offset=8 + 16 * len(h))))
        h, count, length, chars = _merged_words(held)
        save("words", "hash", part, h)
        save("words", "at", part, offsets(length))
        save("words", "chars", part, chars)
        save("words", "count", part, short(count))
        return told(part, len(h), 0, 0, 0, 0, count.sum())

    packed = rows.mapInArrow(lambda it: _gathered(it, _word_counts, _merged_words, packed_words, WORDS), PACKED)
    got = collected(packed.groupBy("part").applyInArrow(word_part, grouped), parts)
    words = joined(SortedParts(folder, "words", [r["n"] if r else 0 for r in got]), "hash", "at", "chars", "count")
    n_words, n_tokens = int(words.at[-1]), sum(r["total"] for r in got if r)

    # n-grams of two words and more; of the longest also, packed by the parts of those one shorter, how they follow and continue these
    def counted(length: int, shorter: SortedParts, between: list[SortedParts]) -> tuple[SortedParts, list[int], DataFrame | None]:
        """The n-grams of a length, from the ids of those one shorter; the longest give their discounts' numbers and statistics."""
        most = int(shorter.at[-1])
        kind = "<u4" if most < (1 << 32) - 1 else "<u8"
        kinds, name, top = (kind, kind, "<u4"), f"grams{length}", length == order

        def entries(raw: list[bytes]) -> list[np.ndarray]:
            t = tokens(raw)
            rep, inverse = distinct(t.flat, t.start, t.length, t.hash)
            *_, x = followed(t, words.find_words(t.hash[rep], t.flat, t.start[rep], t.length[rep]), inverse, n_words, between)
            return summed_pairs(x.shorter[x.before], x.shorter[x.own])

        def packed(grams: list[np.ndarray]) -> pa.RecordBatch:
            before, own, count = grams
            part = part_of(pair_hash(before, own), parts).astype(np.uint16 if parts < 1 << 16 else np.int64)
            to = np.argsort(part, kind="stable")
            return _rows(part[to], 0, *(x.astype(k)[to] for x, k in zip((before, own, count), kinds)))

        def part_saved(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            before, own, counts = (np.concatenate(x) for x in zip(*(opened(d.as_py(), *kinds) for d in table.column("data"))))
            if kind == "<u4":  # the hashes tell the pairs
                keys, counts = summed(pair_hash(before, own), counts)
                before, own = hashed_pair(keys) if top else (None, None)
            else:
                before, own, counts = summed_pairs(before, own, counts)
                to, keys = ordered(pair_hash(before, own))
                before, own, counts = before[to], own[to], counts[to]
            save(name, "hash", part, keys)
            save(name, "count", part, short(counts))
            if top:
                return _statistics(part, shorter, before, own, counts, False)
            if kind == "<u8":
                save(name, "before", part, before)
                save(name, "own", part, own)
            return pa.Table.from_batches([_sent([-1], 3, [np.array([part, len(keys), 0, 0, 0, 0], np.int64).tobytes()])])

        sent = rows.mapInArrow(lambda it: _gathered(it, entries, lambda held: summed_pairs(*(np.concatenate(x) for x in zip(*held))), packed, PAIRS), PACKED)
        stats = shared.written(sent.groupBy("part").applyInArrow(part_saved, PACKED), f"{name}-statistics")
        sizes, numbers = _numbers(stats, parts)
        return joined(SortedParts(folder, name, sizes), "hash", "count", *(() if top or kind == "<u4" else ("before", "own"))), numbers, stats

    levels, numbers, stats = [words], [], None
    for length in range(2, order + 1):
        if stats is not None:
            shared.drop_tables(stats)
        made, numbers, stats = counted(length, levels[-1], levels[1:])
        levels.append(made)
    of_length = {order: numbers}

    # what follows and precedes each n-gram, from the longest down
    def gram_stats(length: int) -> DataFrame:
        own_parts, shorter = levels[length - 1], levels[length - 2]

        def run(table: pa.Table) -> pa.Table:
            group = table.column("part")[0].as_py()
            own = range(own_parts.group[group], own_parts.group[group + 1])
            base, n = int(own_parts.at[own.start]), int(own_parts.at[own.stop] - own_parts.at[own.start])
            if not n:
                return pa.Table.from_batches([_sent([], 0, [])])
            dense = _dense(table, base, n, length + 1 < order)
            at = [own_parts.place(p) for p in own if own_parts.sizes[p]]
            raw = np.concatenate([own_parts.counts("count", f, np.arange(x.start, x.stop)) for f, x in at])
            dense["adjusted"] = np.where(dense["cont"] > 0, dense["cont"], raw)
            save_group(own_parts, group, {k: dense[k] for k in ("n1", "n2", "n3", "adjusted", *(["total"] if length + 1 < order else []))})
            whole = lambda column: np.concatenate([own_parts.column(column, f)[x] for f, x in at])
            before, last = hashed_pair(whole("hash")) if int(shorter.at[-1]) < (1 << 32) - 1 else (whole("before"), whole("own"))
            return _statistics(own.start, shorter, before, last, dense["adjusted"], True)

        # a group whose n-grams nothing longer follows or continues has statistics of its own n-grams to give all the same
        each = spark.range(len(own_parts.group) - 1).select(F.col("id").cast("int").alias("part"), F.lit(0).alias("kind"), F.lit(bytearray()).alias("data"))
        return stats.where("kind < 3").unionByName(each).groupBy("part").applyInArrow(run, PACKED)

    for length in range(order - 1, 1, -1):
        used, stats = stats, shared.written(gram_stats(length), f"grams{length}-statistics")
        shared.drop_tables(used)
        of_length[length] = _numbers(stats, parts)[1]
        joined(levels[length - 1], "n1", "n2", "n3", "adjusted", *(["total"] if length + 1 < order else []))

    groups = len(words.group) - 1

    def word_stats(table: pa.Table) -> pa.Table:
        group = table.column("part")[0].as_py()
        base, n = (n_words, 1) if group == groups else (int(words.at[words.group[group]]), int(words.at[words.group[group + 1]] - words.at[words.group[group]]))
        dense = _dense(table, base, n, order > 2)
        if group == groups:  # what begins a text
            return told(group, *(int(dense[k][0]) for k in ("n1", "n2", "n3")), 0, 0, 0)
        save_group(words, group, dense)
        c = _of_counts(dense["cont"])
        return told(group, int((dense["cont"] >= 3).sum()), *c, int(dense["cont"].sum()))

    got = collected(stats.where("kind < 3").groupBy("part").applyInArrow(word_stats, grouped), groups + 1)
    shared.drop_tables(stats)
    joined(words, "n1", "n2", "n3", "cont", *(["total"] if order > 2 else []))
    start, got = got[groups], [r for r in got[:groups] if r]
    of = [sum(r[f"c{k}"] for r in got) for k in (1, 2, 3, 4)]
    return KneserNey(
        words, [Grams(g, "count" if k == order else "adjusted", discounts(of_length[k])) for k, g in enumerate(levels[1:], 2)], n_tokens,
        [start["n"], start["c1"], start["c2"], n_docs] if start else [0, 0, 0, 0],
        discounts(of), sum(r["total"] for r in got), [of[0], of[1], sum(r["n"] for r in got)],
    )


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches, size=TEXT):
            s = model.score(raw)
            n = pa.array(np.full(len(raw), model.tokens, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s["n_tokens"]), pa.array(s["n_known"]), n, pa.array(s["base_score"]), pa.array(s["score"])], names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score_held_out(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """All rows scored by a model of ``order`` of those whose crc32 of doc_id as text, modulo 7, is not 2.

    A null text counts as empty: its end is its only token. A null doc_id is in no fold: its row is
    trained on and has held_out false. Repeated rows count as often as they occur. Without training
    rows every word is unknown. An empty table gives an empty result; extra columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    scored = score(docs, train(docs.where(~held), order))
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
