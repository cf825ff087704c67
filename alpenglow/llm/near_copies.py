"""Near copies: all pairs of texts whose sets of 5-word shingles have a Jaccard similarity of at least 0.8.

Equal texts are taken once. Then come two joins, and a link of either is one of whole sets compared:

1. SimHash, by operator 3's fingerprints (of 5-word shingles) and its tiles: texts whose fingerprints
   chain at RADIUS differing bits are compared with each other. Large groups of copies are one
   component after that, at a cost that grows with their texts, not with their shingles.
2. Fingerprints miss pairs, so a set-similarity join without misses finds the rest. In any one order
   of the shingles, two such sets of n and m share a shingle within the first ``n - ceil(0.8 n) + 1``
   of the one and ``m - ceil(0.8 m) + 1`` of the other. Only these are dealt into buckets by shingle.
   The order is that of the number of texts that hold a shingle (`tallies`), which makes groups small
   and leaves out no pair. Groups that are large all the same, and those of fingerprints, are dealt
   over many tasks (`shares`).

Within a group (a fingerprint component, or the texts that share a shingle) only texts of different
components and of sizes that may be similar meet. First come bitmaps of about two bits a shingle,
each shingle flipping one: as exclusive-or and bit counts tell how many shingles two sets at least
don't share, most pairs end there, and none that is similar. For the others the whole sets are
compared, read like the bitmaps from files in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import files, shared, shares, simhash, tallies
from alpenglow.llm.simhash import labels_of
from alpenglow.llm.vector import offsets, ragged, texts, trim
from alpenglow.operators.components import components

WIDTH = 5
#: The least similarity of a link, as a fraction.
OVER, UNDER = 4, 5
#: Shingles of fewer texts count as in none, in the order of shingles.
FREQUENT = 16
#: Bits in which fingerprints of linked texts differ at most; what they miss the shingles find.
RADIUS = 3
#: Shingles of a bucket, about.
BUCKET = 125_000
#: Texts of a bucket of fingerprint components, and rows of a file of kept ones, about.
CHAINED, KEPT = 10_000, 1 << 20
#: Shingles that a task gathers before it writes them.
HELD = 2_000_000
#: Places beside it at which a text is compared first; pairs compared at once after that.
BESIDE, PAIRS = 4, 1 << 20
_BLOCK, _START = 14, 28
_MIX = np.uint64(0x9E3779B97F4A7C15)


def distinct(hashes: bytes) -> np.ndarray:
    """Sorted distinct shingles of :func:`simhash.hashed`; the shingle 0 for none."""
    return np.unique(np.frombuffer(hashes, np.uint64)) if hashes else np.zeros(1, np.uint64)


def shingles(raw: bytes, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle, a text without words the shingle 0."""
    return distinct(simhash.hashed(raw, width))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have a Jaccard similarity of OVER / UNDER or more."""
    if len(a) > len(b):
        a, b = b, a
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common * (UNDER + OVER) >= OVER * (len(a) + len(b))


def n_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmap of a set: a power of two, of two to four bits a shingle."""
    return np.maximum(4, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2 / 64)).astype(np.int64).clip(0))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Every shingle flips one bit; halves of a bitmap, one on the other by exclusive-or, are the bitmap of half the length."""
    bits = np.bincount((s % np.uint64(64 * int(n_words(np.array(len(s)))))).astype(np.int64), minlength=64 * int(n_words(np.array(len(s))))) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def may_be_similar(flat: np.ndarray, at: np.ndarray, words: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of sets can be similar, by bitmaps ``flat[at:at+words]``: two differ in no more bits than the sets in shingles."""
    ok = np.zeros(len(a), bool)
    least = np.minimum(words[a], words[b])
    for w in np.unique(least).tolist():
        every = np.flatnonzero(least == w)
        for part in np.array_split(every, max(1, len(every) * w >> 20)):
            x, y = a[part], b[part]
            bits = flat[at[x][:, None] + np.arange(w)] ^ flat[at[y][:, None] + np.arange(w)]
            for side in (x, y):
                long = np.flatnonzero(words[side] > w)  # twice as long at most, as sizes of similar sets differ by a fifth
                bits[long] ^= flat[at[side[long]][:, None] + w + np.arange(w)]
            differ = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
            # similar sets of n and m shingles share OVER / (OVER + UNDER) of n + m or more
            ok[part] = differ * (OVER + UNDER) <= (size[x] + size[y]) * (UNDER - OVER)
    return ok


def prefix(s: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of the shingles of a set of which any similar set has one among its own: first those of the fewest texts."""
    n = len(s) + (-OVER * len(s) // UNDER) + 1
    return np.argsort(count, kind="stable")[:n] if count.any() else np.arange(len(s))[:n]


def _open(token: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Which rows are in groups (of a token, in order) of more than one component."""
    if not len(token):
        return np.zeros(0, bool)
    cut = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    return np.repeat(np.minimum.reduceat(own, cut) != np.maximum.reduceat(own, cut), np.diff(np.r_[cut, len(token)]))


def bucket_links(token: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, read, bitmaps, asked: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Verified links (root, least root of its component) among texts that share a token and have different ``root``s.

    ``read(node)`` gives a set, ``bitmaps(nodes, sizes)`` their bitmaps one after another. If
    ``asked`` is given, pairs without an asked row are left to others.
    """
    every = asked is None
    asked = np.ones(len(token), bool) if every else asked
    order = np.lexsort((node, size, token))
    token, node, size, root, asked = (v[order] for v in (token, node, size, root, asked))
    keep = _open(token, root)
    token, node, size, root, asked = (v[keep] for v in (token, node, size, root, asked))
    ids, first, x = np.unique(node, return_index=True, return_inverse=True)
    size, root, n = size[first], root[first], len(ids)
    _, least, of = np.unique(root, return_index=True, return_inverse=True)
    label = least[of]
    words = n_words(size)
    flat, at = bitmaps(ids, size), offsets(words)[:-1]
    refused = np.zeros(0, np.int64)

    def settle(a: np.ndarray, b: np.ndarray) -> None:
        """Compares the pairs, and those of two components only until one links them."""
        nonlocal label, refused
        fits = (label[a] != label[b]) & (np.minimum(size[a], size[b]) * UNDER >= np.maximum(size[a], size[b]) * OVER)
        pair = np.unique(np.minimum(a, b)[fits] * n + np.maximum(a, b)[fits])
        pair = pair[may_be_similar(flat, at, words, size, pair // n, pair % n)]
        pair = np.setdiff1d(pair, refused, assume_unique=True)
        take = 1
        while len(pair):
            p, q = label[pair // n], label[pair % n]
            between = np.minimum(p, q) * n + np.maximum(p, q)
            order = np.argsort(between, kind="stable")
            pair, between = pair[order], between[order]
            cut = np.flatnonzero(np.r_[True, between[1:] != between[:-1]])
            now = np.arange(len(pair)) - np.repeat(cut, np.diff(np.r_[cut, len(pair)])) < take
            a, b = pair[now] // n, pair[now] % n
            ok = np.fromiter((similar(read(int(ids[p])), read(int(ids[q]))) for p, q in zip(a.tolist(), b.tolist())), bool, len(a))
            refused = np.union1d(refused, pair[now][~ok])
            label = labels_of(n, a[ok], b[ok], label)
            pair = pair[~now]
            pair = pair[label[pair // n] != label[pair % n]]
            take *= 2

    for d in range(1, BESIDE + 1):  # links most of a group of copies
        i = np.flatnonzero(token[d:] == token[:-d])
        settle(x[i], x[i + d])
        keep = _open(token, label[x])
        token, x, asked = token[keep], x[keep], asked[keep]
    if len(x):
        # all that are not of a group's largest component meet all of its texts of sizes near their own
        group = np.cumsum(np.r_[True, token[1:] != token[:-1]]) - 1
        of, one, count = np.unique(group * n + label[x], return_index=True, return_counts=True)
        order = np.lexsort((count, of // n))
        largest = x[one[order[np.r_[np.flatnonzero(np.diff(of[order] // n)), len(of) - 1]]]]  # a text of it, by group
        key = group * (2 * int(size.max()) + 2) + size[x]
        low = np.searchsorted(key, key - size[x] + -(-OVER * size[x] // UNDER))
        high = np.searchsorted(key, key - size[x] + UNDER * size[x] // OVER, "right")
        rows = np.flatnonzero(asked)
        while len(rows):
            if every:  # else the others of a pair need not ask here
                rows = rows[label[x[rows]] != label[largest[group[rows]]]]
            m = max(1, int(np.searchsorted(np.cumsum(high[rows] - low[rows]), PAIRS, "right")))
            some, rows = rows[:m], rows[m:]
            settle(np.repeat(x[some], high[some] - low[some]), x[ragged(low[some], high[some] - low[some])])
    u, one = np.unique(root, return_index=True)
    v = root[label[one]]
    return u[u != v], v[u != v]


def _share(node: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """A share of each node, of so many; 0 of one."""
    return ((node.astype(np.uint64) * _MIX) >> np.uint64(32)) % shares.astype(np.uint64)


def hashes() -> list[Column]:
    """Two hashes ``h1``, ``h2`` of the column ``text``."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("near"), text, F.length(text)).alias("h2")]


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies: that of the smallest doc_id, null ids last; of rows that share it, that of the least text hashes.

    Rows of one doc_id but different texts are documents of their own. All columns stay, whatever their names.
    """
    spark = docs.sparkSession
    path = shared.fresh(spark, "copies")
    with shared.scratch(spark):  # sets, bitmaps and links are as large as the texts; they go here
        near_copies(docs).write.parquet(path)
    shared.release(spark)
    rows = spark.read.schema("doc_id long, h1 long, h2 long, component long").parquet(path)
    each = rows.groupBy("component", "doc_id", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    least = each.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h1", "h2", "n")).alias("x"))
    times, most = _looked_up(least.select("x.*"), rows.count())
    # found in files rather than by a join, which would deal out the texts once more
    given = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *hashes())
    found = given.withColumn("n", times(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "h1", "h2"))
    if most < 2:
        return found.where("n = 1").select("row.*")
    several = found.where("n > 1").groupBy("doc_id", "h1", "h2").agg(F.first("row").alias("row"))  # repeated rows, or rows of one id and text
    return found.where("n = 1").select("row").union(several.select("row")).select("row.*")


def _looked_up(kept: DataFrame, n: int) -> tuple[Callable[..., Column], int]:
    """A function of (whether doc_id is null, doc_id or 0, h1, h2) that gives the ``n`` of that row of ``kept``, 0 if it has none; the largest ``n``."""
    spark = kept.sparkSession
    folder = shared.fresh(spark, "kept")
    parts = -(-max(n, 1) // KEPT)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]) for batch in batches]
        if rows and (rows := np.concatenate(rows, axis=1)).shape[1]:
            part = int(rows[0, 0])
            files.save(f"{folder}/{part}.npy", np.ascontiguousarray(rows[1:, np.lexsort(rows[1:5][::-1])]))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([int(rows[5].max())])], names=["part", "most"])

    part = F.pmod("h1", F.lit(parts)).cast("int")
    dealt = kept.select(part.alias("part"), "h1", "h2", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("none").cast("long").alias("none"), "n")
    there = {r.part: r.most for r in dealt.repartitionById(parts, F.col("part")).mapInArrow(save, "part long, most long").collect()}

    @F.arrow_udf("long")
    def times(none: pa.Array, doc: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        ask = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (h1, h2, doc, none)])
        out = np.zeros(ask.shape[1], np.int64)
        of = ask[0] % parts
        for k in np.unique(of).tolist():
            if k in there:
                rows = files.load(f"{folder}/{k}.npy")
                mine = np.flatnonzero(of == k)
                at, end = (np.searchsorted(rows[0], ask[0, mine], side) for side in ("left", "right"))
                while len(mine := mine[(go := at < end)]):  # rows of one h1: mostly one
                    at, end = at[go], end[go]
                    same = (rows[:4, at] == ask[:, mine]).all(axis=0)
                    out[mine[same]] = rows[4, at[same]]
                    at = at + 1
        return pa.array(out)

    return times, max(there.values(), default=0)


def near_copies(docs: DataFrame) -> DataFrame:
    """``(doc_id, h1, h2, component)`` of every row: its text's hashes (:func:`hashes`) and a component that links reach.

    Texts are linked if their sets of shingles are at least OVER / UNDER similar; words are what
    white space parts, in lower case. Texts without words (also null) are alike. Repeated rows and
    rows with a null doc_id take part like any other. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *hashes(), F.col("text").cast("string").alias("text"))
    folder = shared.fresh(spark, "shingles")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def saved() -> pa.RecordBatch:
            sets = [s for h in held for s in h[1]]
            size = np.array([len(s) for s in sets], np.int64)
            base = part << _BLOCK | k
            files.save(f"{folder}/{base}.npy", np.concatenate(sets))
            files.save(f"{folder}/{base}-bits.npy", np.concatenate([bitmap(x) for x in sets]))
            files.save(f"{folder}/{base}-at.npy", np.stack((offsets(size)[:-1], offsets(n_words(size))[:-1])))
            node = (base << _START) + offsets(size)[:-1]
            given = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            fp = np.array([f for h in held for f in h[2]], np.uint64).view(np.int64)
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() for c in given.columns), pa.array(node), pa.array(size), pa.array(fp)], names=["doc_id", "h1", "h2", "node", "size", "fp"])

        for batch, raw in texts(batches):
            digests = [simhash.hashed(x, WIDTH) for x in raw]
            held.append((batch.select(["doc_id", "h1", "h2"]), [distinct(x) for x in digests], [simhash.folded(x) for x in digests]))
            if sum(len(s) for h in held for s in h[1]) >= HELD:
                yield saved()
                held, k = [], k + 1
        if held:
            yield saved()

    placed = shared.written(rows.mapInArrow(place, "doc_id long, h1 long, h2 long, node long, size long, fp long"), "placed")
    # equal texts have equal sizes and fingerprints
    each = shared.written(placed.groupBy("h1", "h2").agg(*[F.min(c).alias(c) for c in ("node", "size", "fp")]), "texts")
    n, total, every = each.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(F.expr(x)), F.lit(0)) for x in (f"size - ceil(size * {OVER} / {UNDER}) + 1", "size")]).first()
    buckets, parts = max(1, int(total) // BUCKET), int(every) // tallies.PART + 1
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets)

    def by_block(table: DataFrame, *columns: str) -> DataFrame:
        return table.select(*columns).repartition(spread, F.shiftright("node", _START)).sortWithinPartitions("node")

    large = shares.SHARE
    most = tallies.tally(by_block(each, "node", "size"), folder, _START, parts, FREQUENT)
    shared.release(spark)

    def heads(batch: pa.RecordBatch) -> list[np.ndarray]:
        """The first shingles of sets: token, texts that hold it, node, size, root."""
        node, size, root = (np.asarray(c) for c in batch.columns)
        out = []
        for b in np.unique(node >> _START).tolist():
            mine = np.flatnonzero(node >> _START == b)
            m = size[mine]
            token = np.asarray(files.load(f"{folder}/{b}.npy")[ragged(node[mine] & ((1 << _START) - 1), m)])
            count = tallies.counts(token, files.load(f"{folder}/{b}-often.npy"), parts)
            at = offsets(m)
            first = [x + prefix(token[x:y], count[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
            row, place = np.repeat(mine, [len(x) for x in first]), np.concatenate(first)
            out.append((token[place], count[place], node[row], size[row], root[row]))
        return [np.concatenate(v) for v in zip(*out)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first shingles of sets, packed for their buckets; a shingle of many texts has shares, with tokens of their own."""
        for batch in batches:
            if not batch.num_rows:
                continue
            token, count, *given = heads(batch)
            token = token + _share(given[0], np.maximum(-(-count // large), 1)) * _MIX
            to = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            to = to[order]
            cut = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)]
            spans = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            data = [[v[a:b].tobytes() for a, b in spans] for v in (v[order] for v in (token, *given))]
            yield pa.RecordBatch.from_arrays([pa.array(to[cut[:-1]], pa.int64()), *(pa.array(v, pa.binary()) for v in data)], names=["bucket", "token", "node", "size", "root"])
        files.forget()
        trim()

    def of_many(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the first shingles those with shares."""
        for batch in batches:
            if batch.num_rows:
                token, count, *given = heads(batch)
                some = count > large
                yield pa.RecordBatch.from_arrays([pa.array(v[some].view(np.int64)) for v in (token, *given)], names=["token", "node", "size", "root"])
        files.forget()
        trim()

    def compare(token: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, asked: np.ndarray | None = None) -> pa.Table:
        sizes: dict[int, int] = {}

        def read(at: int) -> np.ndarray:
            start = at & ((1 << _START) - 1)
            return np.asarray(files.load(f"{folder}/{at >> _START}.npy"))[start : start + sizes[at]]

        def bitmaps(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
            """Block by block, as ids ascend."""
            sizes.update(zip(ids.tolist(), size.tolist()))
            out = [np.zeros(0, np.uint64)]
            block = ids >> _START
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(ids)])
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(ids)]):
                start, at = files.load(f"{folder}/{block[a]}-at.npy")
                place = at[np.searchsorted(start, ids[a:b] & ((1 << _START) - 1))]
                out.append(files.load(f"{folder}/{block[a]}-bits.npy")[ragged(np.asarray(place), n_words(size[a:b]))])
            return np.concatenate(out)

        u, v = bucket_links(token, node, size, root, read, bitmaps, asked)
        files.forget()
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def chained(dealt: pa.Table) -> pa.Table:
        token, node, size = (dealt.column(c).to_numpy() for c in ("token", "node", "size"))
        return compare(token, node, size, node)

    def shared_shingles(dealt: pa.Table) -> pa.Table:
        kinds = (("token", np.uint64), ("node", np.int64), ("size", np.int64), ("root", np.int64))
        return compare(*(np.frombuffer(b"".join(dealt.column(c).to_pylist()), kind) for c, kind in kinds))

    fps = shared.written(each.select("fp").distinct(), "fingerprints")
    chains = components(simhash.links(fps, RADIUS)).withColumnRenamed("node", "fp")
    by_chain = shared.written(each.join(chains, "fp", "left").select("node", "size", F.coalesce("root", "fp").alias("token")), "chains")
    by_chain = shares.split(by_chain).withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(-(-max(n, 1) // CHAINED))))
    first = components(by_chain.groupBy("bucket").applyInArrow(chained, shares.LINKS))
    known = shared.written(each.join(first, "node", "left").select("h1", "h2", "node", "size", F.coalesce("root", "node").alias("root")), "known")
    dealt = by_block(known, "node", "size", "root").mapInArrow(deal, "bucket long, token binary, node binary, size binary, root binary")
    found = shared.written(dealt.groupBy("bucket").applyInArrow(shared_shingles, shares.LINKS), "found")
    if most > large:
        hot = shared.written(by_block(known, "node", "size", "root").mapInArrow(of_many, "token long, node long, size long, root long"), "of_many")
        found = shares.links(hot, found, compare)
    rest = components(found).select(F.col("node").alias("root"), F.col("root").alias("last"))
    ends = known.select("h1", "h2", "root").join(rest, "root", "left").select("h1", "h2", F.coalesce("last", "root").alias("component"))
    return placed.select("doc_id", "h1", "h2").join(ends, ["h1", "h2"]).select("doc_id", "h1", "h2", "component")
