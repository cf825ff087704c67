"""Operator 2: removal of repeated substrings by a hash-compared suffix sort.

A byte goes if it lies in a string of ``length`` bytes that also starts earlier. Every such string
(a window) is owned by its anchor, the ``ANCHOR``-byte string of the least hash in it, so that equal
windows have equal anchors at equal places. The windows that follow each other under one anchor make
a block. Hashes only bring together what may be equal; whether it is, the sort and the bytes decide.

1. A slice of text gives its blocks. Those that look alike within the slice are sorted there as
   suffixes, and all but the first of equal ones are settled as repeated. What anchors the others
   have goes, packed, to buckets by anchor hash; a bucket finds the anchors that come more than once.
2. The blocks of these are cut from their texts and dealt by anchor, ``HOT`` at most to a group. A
   group sorts first its blocks, then the windows of the blocks that are left, by a mergesort that
   compares two suffixes by their common extension, found from prefix polynomial hashes by binary
   search. The order found and the equality of neighbours are checked byte by byte; a segment that a
   hash collision put in a wrong order is sorted by its bytes. All but the first of equals go.
3. Windows left over from an anchor of several groups are dealt once more by their hashes, so that
   no task ever gets all of a frequent anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alpenglow.functions.numbering import numbered
from alpenglow.llm import shared
from alpenglow.llm.vector import PrefixHash, mix, offsets, pack, part_of, ragged, texts, trim, unpack

LENGTH, ANCHOR = 100, 32
#: Blocks of an anchor in a group.
HOT = 4096
#: Bytes of blocks sorted at once.
SORTED = 1 << 20
#: Bytes of text hashed at once; their arrays take some hundred times as much. Longer texts are cut.
SLICE = 1 << 19
#: Text bytes of a partition at most, however few shuffle partitions are set.
PARTITION = 64 << 20
#: Blocks that a task gathers before it packs them.
HELD = 1 << 19
_POSITION = 28
#: Bytes of blocks that a task gathers before it sends them on, and those of a bucket.
SENT, BUCKET = 4 << 20, 24 << 20
PACKED = ("<u8", "<i8", "<u4", "<u2", "<u2")  # h, doc, start, n, d
BLOCKS = ("<u8", "<i8", "<u4", "<u2", "<u2", "<i4")  # key, doc, start, n, d, share
MARKS = "doc long, start long, n long, d int, h long, share int"


def blocks(flat: np.ndarray, doc_at: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, for texts ``flat[doc_at[i]:doc_at[i+1]]``.

    Gives for each run its text, first window, number of windows, distance from there to the
    anchor, and the anchor's hash.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    windows = np.maximum(np.diff(doc_at) - length + 1, 0)
    if not windows.any():
        return none
    first = PrefixHash(flat)
    n = len(flat) - anchor + 1
    at = np.arange(n, dtype=np.int64)
    low = np.uint64((1 << _POSITION) - 1)
    least = (mix((first.sums[anchor:] - first.sums[:-anchor]) * first.inverse[:n]) & ~low) | at.view(np.uint64)
    span = length - anchor + 1  # anchors in a window
    have = 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    text = np.repeat(np.arange(len(windows)), windows)
    start = ragged(doc_at[:-1], windows)
    owner = (least[start] & low).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])])
    count = np.diff(np.r_[new, len(start)])
    begin, own = start[new], owner[new]
    return text[new], begin - doc_at[text[new]], count, own - begin, first.span(own, own + anchor)


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of one text taken together."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    _, rank = np.unique(doc, return_inverse=True)
    wide = int(end.max()) + 2
    reach = np.maximum.accumulate(end + rank * wide)
    new = np.r_[True, (start[1:] + rank[1:] * wide) > reach[:-1]]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(doc)] - 1
    return doc[first], start[first], reach[last] - rank[last] * wide


def _lcp(hashes: PrefixHash, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Common extension of the suffixes at x and y, up to ``most`` bytes of each, by binary search over prefix hashes."""
    low, high = most.copy(), most - 1
    todo = np.flatnonzero(hashes.equal_length(x, most) != hashes.equal_length(y, most))
    low[todo] = 0
    while len(todo):
        mid = (low[todo] + high[todo] + 1) >> 1
        equal = hashes.equal_length(x[todo], mid) == hashes.equal_length(y[todo], mid)
        low[todo[equal]] = mid[equal]
        high[todo[~equal]] = mid[~equal] - 1
        todo = todo[low[todo] < high[todo]]
    return low


def suffix_sort(flat: np.ndarray, hashes: PrefixHash, at: np.ndarray, segment: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Stable mergesort of the suffixes ``at`` within their segments (sorted ids), on their first ``most`` bytes; the order.

    ``most`` is one number in a segment. All runs of all segments are merged at once: an element's
    new place is its rank in its own run and, by binary search, in the run beside it.
    """
    order = np.arange(len(at))
    if not len(at):
        return order
    head = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    size = np.diff(np.r_[head, len(at)])
    base, total = np.repeat(head, size), np.repeat(size, size)
    place = np.arange(len(at)) - base
    width = 1
    while width < size.max():
        run = place // width
        mine, beside = run * width, (run ^ 1) * width
        n = np.clip(total - beside, 0, width)
        act = np.flatnonzero(n)
        low, high = np.zeros(len(at), np.int64), n.copy()
        right = (run & 1).astype(bool)
        while len(act):
            mid = (low[act] + high[act]) >> 1
            x, y, full = at[order[act]], at[order[base[act] + beside[act] + mid]], most[act]
            common = _lcp(hashes, x, y, full)
            inner = np.minimum(common, full - 1)
            before = np.where(common < full, flat[y + inner] < flat[x + inner], right[act])  # the other stands before x
            low[act[before]] = mid[before] + 1
            high[act[~before]] = mid[~before]
            act = act[low[act] < high[act]]
        new = base + np.minimum(mine, np.where(n > 0, beside, mine)) + (place - mine) + low
        moved = order.copy()
        moved[new] = order
        order = moved
        width *= 2
    return order


def _beside(flat: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings of equal sizes at x and y: which are equal, and which x stand after their y, byte by byte."""
    equal, after = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if not len(x):
        return equal, after
    for part in np.array_split(np.arange(len(x)), max(1, int(size.sum()) // SORTED)):
        if not len(part):
            continue
        s = size[part]
        if (s == s[0]).all():
            every = np.lib.stride_tricks.sliding_window_view(flat, int(s[0]))
            p, q = every[x[part]], every[y[part]]
            first = (p != q).argmax(axis=1)
            p, q = p[np.arange(len(part)), first], q[np.arange(len(part)), first]
        else:
            i, j = ragged(x[part], s), ragged(y[part], s)
            bounds = offsets(s)
            first = np.minimum.reduceat(np.where(flat[i] != flat[j], np.arange(len(i)), len(i)), bounds[:-1])
            first = np.minimum(first, bounds[1:] - 1)
            p, q = flat[i[first]], flat[j[first]]
        equal[part], after[part] = p == q, p > q
    return equal, after


def classes(flat: np.ndarray, hashes: PrefixHash, at: np.ndarray, segment: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes within their segments, equal ones as given, and which equals the one before it.

    Both are true of the bytes: where a collision of hashes has led the sort astray, bytes sort the segment.
    """
    order = suffix_sort(flat, hashes, at, segment, most)
    equal = np.zeros(len(at), bool)
    pair = np.flatnonzero(segment[1:] == segment[:-1])  # the order keeps every segment at its place
    whole = np.bincount(order, minlength=len(at)) == 1
    if whole.all():
        equal[pair + 1], after = _beside(flat, at[order[pair]], at[order[pair + 1]], most[pair])
        astray = np.unique(segment[pair[after]])
    else:
        equal[pair + 1], after = _beside(flat, at[order[pair]], at[order[pair + 1]], most[pair])
        astray = np.unique(np.concatenate((segment[pair[after]], segment[~whole])))
    for s in astray.tolist():
        own = np.arange(np.searchsorted(segment, s), np.searchsorted(segment, s, "right"))
        text = [flat[a : a + k].tobytes() for a, k in zip(at[own].tolist(), most[own].tolist())]
        rank = sorted(range(len(own)), key=lambda k: (text[k], k))
        order[own] = own[rank]
        equal[own[1:]] = [text[a] == text[b] for a, b in zip(rank, rank[1:])]
    return order, equal


def _judged(flat: np.ndarray, hashes: PrefixHash, at: np.ndarray, keys: list[np.ndarray], most: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of strings ``flat[at:at+most]``: which are the first of their kind in the order of (doc, start), and which come after it.

    Equal strings have equal ``keys``. A string that is given twice, at one place, is once neither.
    """
    order = np.lexsort((start, doc, *keys))
    differs = np.zeros(max(len(order) - 1, 0), bool)
    for k in keys:
        differs |= k[order][1:] != k[order][:-1]
    segment = np.cumsum(np.r_[True, differs])[: len(order)]
    some = np.bincount(segment)[segment] > 1
    first, later = np.ones(len(order), bool), np.zeros(len(order), bool)
    order, segment = order[some], segment[some]
    if len(order):
        new, equal = classes(flat, hashes, at[order], segment, most[order])
        order = order[new]
        head = order[np.maximum.accumulate(np.where(equal, 0, np.arange(len(order))))]
        first[order] = ~equal
        later[order] = equal & ((doc[order] != doc[head]) | (start[order] != start[head]))
    return first, later


def judge(group: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray, d: np.ndarray, data: list[bytes], length: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Blocks of ``n`` windows, in groups: the windows that equal an earlier one of their group as (doc, start, n), and the first ones as (block, place in it)."""
    flat = np.frombuffer(b"".join(data), np.uint8)
    hashes = PrefixHash(flat)
    at = offsets(n + (length - 1))[:-1]
    first, later = _judged(flat, hashes, at, [n, d, group], n + (length - 1), doc, start)
    gone = [(doc[later], start[later], n[later])]
    left = np.flatnonzero(first)
    block = np.repeat(left, n[left])
    j = ragged(np.zeros(len(left), np.int64), n[left])
    first, later = _judged(flat, hashes, at[block] + j, [d[block] - j, group[block]], np.full(len(block), length), doc[block], start[block] + j)
    gone.append((doc[block[later]], start[block[later]] + j[later], np.ones(int(later.sum()), np.int64)))
    return tuple(np.concatenate(x) for x in zip(*gone)), (block[first], j[first])


class Repeats:
    """Anchors that a bucket has met: how often, and of one met once its only block."""

    def __init__(self):
        self.known = [np.zeros(0, k) for k in PACKED]
        self.count = np.zeros(0, np.int64)

    def add(self, *new: np.ndarray) -> tuple[np.ndarray, ...]:
        """The blocks (h, doc, start, n, d) that can now be told to share their anchor, each once, and their numbers under the anchor."""
        order = np.argsort(new[0], kind="stable")
        new = [x[order] for x in new]
        u, head, size = np.unique(new[0], return_index=True, return_counts=True)
        at = np.searchsorted(self.known[0], u)
        old = np.zeros(len(u), bool)
        old[at < len(self.count)] = self.known[0][at[at < len(self.count)]] == u[at < len(self.count)]
        before = np.zeros(len(u), np.int64)
        before[old] = self.count[at[old]]
        told = np.repeat(before + size > 1, size)
        number = np.repeat(before, size) + np.arange(len(order)) - np.repeat(head, size)
        once = at[old & (before == 1)]
        out = [np.concatenate((k[once], x[told])) for k, x in zip(self.known, new)]
        number = np.concatenate((np.zeros(len(once), np.int64), number[told]))
        self.count[at[old]] += size[old]
        fresh = head[~old]
        order = np.argsort(np.concatenate((self.known[0], u[~old])), kind="stable")
        self.known = [np.concatenate((k, x[fresh]))[order] for k, x in zip(self.known, new)]
        self.count = np.concatenate((self.count, size[~old]))[order]
        return (*out, number)


def _keyed(docs: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows ``(doc, doc_id, text, _0, ...)`` and the distinct documents ``(doc, text)``; doc orders them.

    Where ids repeat, or are null, doc numbers the distinct ids and texts in their order, nulls first.
    """
    names = [f"_{i}" for i in range(len(carry))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)])
    n, ids, null = rows.agg(F.count(F.lit(1)), F.count_distinct("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    if n == ids and not null:
        rows = rows.select(F.col("doc_id").alias("doc"), "doc_id", "text", *names)
        return rows, rows
    each = shared.written(numbered(rows.select("doc_id", "text").distinct(), ["doc_id", "text"], "doc"), "documents")
    rows = rows.alias("r").join(each.alias("e"), F.col("r.doc_id").eqNullSafe(F.col("e.doc_id")) & F.col("r.text").eqNullSafe(F.col("e.text")))
    return rows.select("e.doc", "r.doc_id", "r.text", *[f"r.{c}" for c in names]), each.select("doc", "text")


def _slices(ids: np.ndarray, raw: list[bytes], overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """Texts in pieces of at most SLICE windows, a slice's worth at a time: their ids, places and bytes."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    for i, x in zip(ids.tolist(), raw):
        for a in range(0, max(len(x) - overlap, 0), SLICE):
            held.append((i, a, x[a : a + SLICE + overlap]))
            size += len(held[-1][2])
            if size >= SLICE:
                yield tuple(map(np.array, (list(zip(*held))[:2]))) + ([h[2] for h in held],)
                held, size = [], 0
    if held:
        yield tuple(map(np.array, (list(zip(*held))[:2]))) + ([h[2] for h in held],)


def _batch(names: str, *columns) -> pa.RecordBatch:
    """Columns of ``names``; None is null. Whole numbers become 64 bits wide but for those called d or share."""
    n = next(len(c) for c in columns if c is not None)
    kind = lambda c: pa.binary() if c == "data" else pa.int32() if c in ("d", "share") else pa.int64()
    return pa.RecordBatch.from_arrays([pa.nulls(n, kind(c)) if x is None else pa.array(x, kind(c)) for c, x in zip(names.split(), columns)], names=names.split())


def spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc, doc_id, text, _0, ..., spans array<struct<start, end>>)``: byte intervals that go, and the columns ``carry``."""
    spark = docs.sparkSession
    shared.release(spark)  # what steps before have left
    rows, each = _keyed(docs, carry)
    size = each.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // PARTITION))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks packed for each bucket; windows settled within a slice, packed for any."""
        held: list[tuple[np.ndarray, ...]] = []
        count = 0

        def packed(columns: list[np.ndarray], settled: bool) -> pa.RecordBatch:
            to = part_of(columns[0], partitions).astype(np.int64)
            cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)])
            ends = np.r_[cut[1:], len(to)].astype(np.int64)
            data = [pack(*(c[a:b].astype(k) for c, k in zip(columns, PACKED))) for a, b in zip(cut.tolist(), ends.tolist())]
            return pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array(np.full(len(cut), settled)), pa.array(data, pa.binary())], names=["bucket", "settled", "data"])

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate(x) for x in zip(*held)]
            order = np.argsort(columns[0], kind="stable")
            return packed([c[order] for c in columns], False)

        for batch, raw in texts(batches, size=SLICE):
            for ids, base, pieces in _slices(batch.column(0).to_numpy(zero_copy_only=False), raw, length - 1):
                flat, at = np.frombuffer(b"".join(pieces), np.uint8), offsets(np.array([len(x) for x in pieces]))
                text, start, n, d, h = blocks(flat, at, length, anchor)
                doc, place = ids[text], base[text] + start
                first, later = _judged(flat, PrefixHash(flat), at[text] + start, [n, d, h], n + (length - 1), doc, place)
                held.append((h[first], doc[first], place[first], n[first], d[first]))
                count += len(held[-1][0])
                if later.any():
                    gone, a, b = _merged(doc[later], place[later], place[later] + n[later] + (length - 1))
                    b = b - (length - 1)
                    for k in range(0, int((b - a).max()), 60_000):  # a packed number of windows has 16 bits
                        some = b - a > k
                        g, a_, n_ = gone[some], a[some] + k, np.minimum(b[some] - a[some] - k, 60_000)
                        key = mix(g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + a_.astype(np.uint64))
                        order = np.argsort(key)
                        yield packed([c[order] for c in (key, g, a_, n_, np.zeros(len(g), np.int64))], True)
                if count >= HELD:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks whose anchor comes more than once, with their shares of it; settled windows pass through."""
        names, met = "doc start n d h share", Repeats()
        held: list[list[np.ndarray]] = []

        def told() -> pa.RecordBatch:
            h, doc, start, n, d, number = met.add(*(np.concatenate(x) for x in zip(*held)))
            return _batch(names, doc, start, n, d, h.view(np.int64), number // HOT)

        for batch in batches:
            for settled, data in zip(batch.column(1).to_pylist(), batch.column(2)):
                part = unpack(data.as_py(), *PACKED)
                if settled:
                    yield _batch(names, part[1], part[2], part[3], None, None, None)
                else:
                    held.append(part)
            if sum(len(p[0]) for p in held) >= HELD:
                yield told()
                held = []
        if held:
            yield told()
        del held, met
        trim()

    found = each.select("doc", "text").mapInArrow(anchors, "bucket int, settled boolean, data binary")
    marks = shared.written(found.repartitionById(partitions, F.col("bucket")).mapInArrow(gather, MARKS), "marks")
    shared.release(spark)

    ask = marks.where("h is not null").groupBy("doc").agg(F.collect_list(F.struct("start", "n", "d", "h", "share")).alias("ask"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        bytes_: list[bytes] = []
        count = 0
        for batch, raw in texts(batches, size=SLICE):
            lists = batch.column(2)
            part = lists.flatten()
            of = np.repeat(np.arange(len(raw)), np.asarray(lists.value_lengths()))
            start, n, d, h, share = (part.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            doc = batch.column(0).to_numpy(zero_copy_only=False)[of]
            # a group's key: shares of one anchor are apart, and mixing leaves them evenly spread
            key = mix(h.view(np.uint64) + share.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            held.append((key, doc, start, n, d, share))
            bytes_ += [raw[t][a : a + m - 1 + length] for t, a, m in zip(of.tolist(), start.tolist(), n.tolist())]
            count += int((n + (length - 1)).sum())
            if count >= SENT:
                yield sent(held, bytes_)
                held, bytes_, count = [], [], 0
        if held:
            yield sent(held, bytes_)

    def sent(held: list[tuple[np.ndarray, ...]], data: list[bytes]) -> pa.RecordBatch:
        """Blocks packed for the buckets of their keys; their bytes are compressed together."""
        columns = [np.concatenate(x) for x in zip(*held)]
        to = part_of(columns[0], buckets).astype(np.int64)
        order = np.argsort(to, kind="stable")
        to = to[order]
        cut = np.flatnonzero(np.r_[True, to[1:] != to[:-1]][: len(to)]).tolist()
        rows, some = [], []
        for a, b in zip(cut, [*cut[1:], len(to)]):
            rows.append(pack(*(c[order[a:b]].astype(k) for c, k in zip(columns, BLOCKS))))
            some.append(pa.compress(b"".join([data[i] for i in order[a:b].tolist()]), codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(to[cut], pa.int32()), pa.array(rows, pa.binary()), pa.array(some, pa.binary())], names=["bucket", "blocks", "data"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settles groups; of an anchor's several groups the first windows go on, by their own hashes."""
        for key, doc, start, n, d, share, data in _groups(batches, length):
            gone, (block, j) = judge(key, doc, start, n, d, data, length)
            of, a, b = _merged(gone[0], gone[1], gone[1] + gone[2] + (length - 1))
            yield _batch("key doc start n data", None, of, a, b - a - (length - 1), None)
            _, group, size = np.unique(key, return_inverse=True, return_counts=True)
            several = ((share > 0) | (size[group] >= HOT))[block]
            if several.any():
                block, j = block[several], j[several]
                each = [data[b][a : a + length] for b, a in zip(block.tolist(), j.tolist())]
                at = np.arange(len(each)) * length
                w = PrefixHash(np.frombuffer(b"".join(each), np.uint8)).span(at, at + length)
                yield _batch("key doc start n data", w.view(np.int64), doc[block], start[block] + j, np.ones(len(block), np.int64), each)
        trim()

    def sort_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The same for single windows in the order of (key, doc, start); a group longer than a batch leaves its first windows for the next."""
        left: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if left is not None:
                last = left.filter(pa.compute.equal(left.column("key"), rows.column("key")[0]))
                rows = pa.concat_tables([last, rows])
            key, doc, start = (rows.column(c).to_numpy() for c in ("key", "doc", "start"))
            none = np.zeros(len(key), np.int64)
            gone, (block, _) = judge(key, doc, start, none + 1, none, rows.column("data").to_pylist(), length)
            of, a, b = _merged(gone[0], gone[1], gone[1] + gone[2] + (length - 1))
            yield _batch("doc start n", of, a, b - a - (length - 1))
            left = rows.take(pa.array(np.sort(block[key[block] == key[-1]])))

    asked = marks.where("h is not null").agg(F.coalesce(F.sum(F.col("n") + (length - 1)), F.lit(0))).first()[0]
    buckets = max(partitions, -(-int(asked) // BUCKET))
    pieces = each.select("doc", "text").repartition(partitions, "doc").join(ask, "doc").mapInArrow(extract, "bucket int, blocks binary, data binary")
    judged = pieces.repartitionById(buckets, F.col("bucket")).mapInArrow(sort, "key long, doc long, start long, n long, data binary")
    judged = shared.written(judged, "judged")
    shared.release(spark)
    spread = judged.where("key is not null").select("key", "doc", "start", "data").repartition(partitions, "key").sortWithinPartitions("key", "doc", "start")
    gone = marks.where("h is null").select("doc", "start", "n").union(judged.where("key is null").select("doc", "start", "n")).union(spread.mapInArrow(sort_windows, "doc long, start long, n long"))
    per_doc = gone.groupBy("doc").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") + (length - 1)).alias("end"))).alias("spans"))
    # shuffled again rather than kept from the first join: what that one wrote is gone by now
    return rows.repartition(partitions, "doc").join(per_doc, "doc", "left")


def _groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """The blocks of a bucket in the order of their keys, whole groups of about SORTED bytes at a time: BLOCKS and their bytes."""
    parts, raw = [], []
    for batch in batches:
        for row, data in zip(batch.column(1), batch.column(2)):
            part = unpack(row.as_py(), *BLOCKS)
            parts.append(part)
            raw.append(pa.decompress(data.as_py(), int((part[3].astype(np.int64) + (length - 1)).sum()), codec="zstd", asbytes=True))
    if not parts:
        return
    columns = [np.concatenate(x).astype(np.int64) if k else np.concatenate(x).view(np.int64) for k, x in enumerate(zip(*parts))]
    flat = b"".join(raw)
    del raw, parts
    at = offsets(columns[3] + (length - 1))
    order = np.argsort(columns[0], kind="stable")
    columns = [c[order] for c in columns]
    key, size = columns[0], np.cumsum(columns[3] + (length - 1))
    ends = np.r_[np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)]
    block = size[ends - 1] // SORTED
    a = 0
    for e in ends[np.r_[block[1:] != block[:-1], True]].tolist():
        yield *(c[a:e] for c in columns), [flat[at[i] : at[i + 1]] for i in order[a:e].tolist()]
        a = e


def _union(given: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["end"]) for x in given or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def _kept(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in cut:
        parts.append(raw[at:a])
        at = b
    parts.append(raw[at:])
    return b"".join(parts)


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty. Rows of one doc_id with equal texts are one document; with differing
    texts, or null ids (before all others), they are documents in the order of their texts. Texts
    shorter than ``length`` lose nothing. An empty table gives an empty result; extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw in texts(batches):
            cuts = [_union(s) for s in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()), pa.array([len(c) for c in cuts], pa.int64()), pa.array([hashlib.sha256(_kept(x, c)).hexdigest() for x, c in zip(raw, cuts)], pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return spans(docs, length).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with every text freed of its repeated bytes; other columns stay.

    A removed span is narrowed to whole characters, so what is left stays UTF-8. Null texts stay
    null; a text of which nothing is left is empty. Documents are told apart as in :func:`digests`.
    """
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    kinds = {"doc_id": T.LongType(), "text": T.StringType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in docs.schema.fields])

    def whole(raw: bytes, a: int, b: int) -> tuple[int, int]:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {c: f"_{i}" for i, c in enumerate(carry)}
        for batch, raw in texts(batches):
            kept = [_kept(x, [whole(x, a, b) for a, b in _union(s)]) for x, s in zip(raw, batch.column("spans").to_pylist())]
            null = np.asarray(batch.column("text").is_null())
            left = pa.array([None if z else k.decode() for k, z in zip(kept, null)], pa.string())
            yield pa.RecordBatch.from_arrays([left if c == "text" else batch.column(place.get(c, c)) for c in schema.names], names=schema.names)

    return spans(docs, length, carry=carry).mapInArrow(run, schema)
