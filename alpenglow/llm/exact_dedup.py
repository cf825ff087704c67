"""Operator 11: exact dedup by owners of Patricia tries.

Every task first inserts its own texts into a compressed radix trie, so that of equal texts one goes
on, with its count and smallest identifier: a group of copies reaches its owner with a row a task at
most. Owners hold what has one length and content hash; they insert the full byte strings again, and
each terminal node keeps the smallest identifier. No two texts are called equal for their hash.

A trie that grows beyond its budget gives away a whole subtree, the heaviest below its first fork:
what is in it, and what comes later, is written to the shared folder and becomes the input of a
further round, a partition a subtree. Each trie keeps a string at least, so rounds end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alpenglow.llm import shared
from alpenglow.llm.vector import texts

#: Bytes of labels (with about what a node takes) of a task's own trie and of an owner's; bytes of text for each owner.
LOCAL, OWNER, SHARE = 16 << 20, 64 << 20, 32 << 20
NODE = 300


class Node:
    __slots__ = ("end", "kids", "label")

    def __init__(self, label: bytes, kids: dict | None = None, end: int = -1):
        self.label, self.kids, self.end = label, kids if kids is not None else {}, end


def _common(label: bytes, key: bytes, at: int) -> int:
    """Length of the common prefix of ``label`` and ``key[at:]``, by halving."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == key[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie of byte strings; its terminals are numbered in the order of their first insertion."""

    def __init__(self):
        self.root, self.held, self.terminals, self.cut = Node(b""), 0, 0, 0

    def _terminal(self) -> int:
        self.terminals += 1
        return self.terminals - 1

    def insert(self, key: bytes) -> int:
        """The terminal of ``key``; of a key in a subtree that was given away ``~number`` of that subtree."""
        node, at = self.root, 0
        while at < len(key):
            kid = node.kids.get(key[at])
            if kid is None:
                leaf = Node(key[at:], end=self._terminal())
                node.kids[key[at]] = leaf
                self.held += len(key) - at + NODE
                return leaf.end
            if kid.__class__ is int:
                return ~kid
            if not key.startswith(kid.label, at):
                n = _common(kid.label, key, at)
                fork = Node(kid.label[:n], {kid.label[n]: kid})
                kid.label = kid.label[n:]
                node.kids[key[at]] = kid = fork
                self.held += NODE
            node, at = kid, at + len(kid.label)
        if node.end < 0:
            node.end = self._terminal()
        return node.end

    @staticmethod
    def _under(path: bytes, top: Node) -> Iterator[tuple[bytes, Node]]:
        stack = [(path + top.label, top)]
        while stack:
            key, node = stack.pop()
            yield key, node
            stack.extend((key + k.label, k) for k in node.kids.values() if k.__class__ is not int)

    def spill(self) -> tuple[int, list[tuple[bytes, int]]] | None:
        """Give away the heaviest subtree below the first fork: its number, and its (key, terminal). None if one string is left."""
        node, path = self.root, b""
        while True:
            kids = [k for k in node.kids.values() if k.__class__ is not int]
            if node.end < 0 and len(kids) == 1:
                path, node = path + kids[0].label, kids[0]
                continue
            break
        if not kids:
            return None
        weight = {k.label[0]: sum(len(n.label) + NODE for _, n in self._under(b"", k)) for k in kids}
        first = max(weight, key=weight.get)
        gone = [(key, n.end) for key, n in self._under(path, node.kids[first]) if n.end >= 0]
        node.kids[first] = number = self.cut
        self.cut += 1
        self.held -= weight[first]
        return number, gone


def _least(a: tuple, b: tuple) -> tuple:
    """The smaller of (id, part, row); null ids come last."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] if x[0] is not None else 0, x[1], x[2]))


def _local(docs: DataFrame, kind: str, rest: str) -> DataFrame:
    """Every row with its terminal in its task's trie; the first row of a terminal also has the text, its count and smallest row."""
    schema = f"id {kind}, rest {rest}, part int, row long, node long, text binary, n_bytes long, n long, low {kind}, low_row long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, base = TaskContext.get().partitionId(), 0, 0
        trie, held, ends, first, n, low = Trie(), [], [], [], [], []

        def flush() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks()
            size = len(ends)
            text, count, least, least_row = [None] * size, [None] * size, [None] * size, [None] * size
            raw = own.column("text")
            for k, at in enumerate(first):
                text[at], count[at], (least[at], _, least_row[at]) = raw[at].as_py() or b"", n[k], low[k]
            return pa.RecordBatch.from_arrays(
                [
                    own.column("id").combine_chunks(), own.column("rest").combine_chunks(), pa.array([part] * size, pa.int32()), pa.array(range(row - size, row), pa.int64()),
                    pa.array([base + e for e in ends], pa.int64()), pa.array(text, pa.binary()), pa.array([None if t is None else len(t) for t in text], pa.int64()),
                    pa.array(count, pa.int64()), pa.array(least, own.schema.field("id").type), pa.array(least_row, pa.int64()),
                ],
                names=["id", "rest", "part", "row", "node", "text", "n_bytes", "n", "low", "low_row"],
            )

        for batch, raw in texts(batches):
            held.append(batch)
            for key, doc in zip(batch.column("id").to_pylist(), raw):
                end, mine = trie.insert(doc), (key, part, row)
                if end == len(first):
                    first.append(len(ends))
                    n.append(1)
                    low.append(mine)
                else:
                    n[end] += 1
                    low[end] = _least(low[end], mine)
                ends.append(end)
                row += 1
            if trie.held > LOCAL:
                yield flush()
                base += trie.terminals
                trie, held, ends, first, n, low = Trie(), [], [], [], [], []
        if held:
            yield flush()

    return docs.mapInArrow(run, schema)


_ROWS = ("part", "node", "text", "n", "low", "low_part", "low_row")


def _owners(rows: DataFrame, kind: str) -> DataFrame:
    """For each ``(part, node)`` its whole group, or, with ``text``, the row again and the subtree it waits in."""
    schema = f"part int, node long, text binary, n long, low {kind}, low_part int, low_row long, subtree long, sha string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = TaskContext.get().partitionId() << 32
        trie, members, low, n, sha, kinds = Trie(), [], [], [], [], {}

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), kinds["low"], pa.int32(), pa.int64(), pa.int64(), pa.string()]
            names = ["part", "node", "text", "n", "low", "low_part", "low_row", "subtree", "sha"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

        for batch, raw in texts(batches):
            kinds["low"] = batch.schema.field("low").type
            waiting = []
            for text, mine in zip(raw, zip(*(batch.column(c).to_pylist() for c in _ROWS if c != "text"))):
                part, node, count, least, least_part, least_row = mine
                end = trie.insert(text)
                if end < 0:
                    waiting.append((part, node, text, count, least, least_part, least_row, owner | ~end, None))
                    continue
                if end == len(members):
                    members.append([])
                    low.append((least, least_part, least_row))
                    n.append(0)
                    sha.append(hashlib.sha256(text).hexdigest())
                members[end].append(mine)
                low[end], n[end] = _least(low[end], (least, least_part, least_row)), n[end] + count
            while trie.held > OWNER and (spilled := trie.spill()):
                for text, end in spilled[1]:
                    waiting += [(m[0], m[1], text, *m[2:], owner | spilled[0], None) for m in members[end]]
                    members[end] = []
            if waiting:
                yield batch_of(waiting)
        out: list[tuple] = []
        for own, (least, least_part, least_row), count, digest in zip(members, low, n, sha):
            out += [(m[0], m[1], None, count, least, least_part, least_row, None, digest) for m in own]
            if len(out) >= 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return rows.select(*_ROWS).mapInArrow(run, schema)


def _groups(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    white = F.regexp_replace(F.coalesce(docs[text_col].cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rest = F.struct(*[docs[c] for c in carry]) if carry else F.lit(None).cast("boolean")
    rows = docs.select(docs[id_col].alias("id"), rest.alias("rest"), F.encode(white, "UTF-8").alias("text"))
    local = shared.written(_local(rows, kind, rows.schema["rest"].dataType.simpleString()), "local-tries")
    waiting = local.where("text is not null")
    n_bytes = waiting.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // SHARE))
    waiting = waiting.select("part", "node", "text", "n", "low", F.col("part").alias("low_part"), "low_row", "n_bytes").repartition(parts, "n_bytes", F.xxhash64("text"))
    mine = local.select("id", "rest", "part", "row", "node")
    owned = None
    while True:
        table = shared.written(_owners(waiting, kind), "owners")
        done = table.where("text is null").select("part", "node", F.col("n").alias("size"), F.col("low").alias("keep"), "low_part", "low_row", "sha")
        owned = done if owned is None else owned.union(done)
        left = table.where("text is not null")
        subtrees = left.select("subtree").distinct().count()
        if not subtrees:
            return mine.join(owned, ["part", "node"]).withColumn("kept", (F.col("part") == F.col("low_part")) & (F.col("row") == F.col("low_row")))
        waiting = left.repartition(min(parts, subtrees), "subtree")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, keep_id, group_size, kept, text_sha256)`` of every row; equal texts form a group, of which the row of smallest id stays.

    Texts are compared with every run of white space (space, tab to carriage return) as one space; a
    null text counts as empty, and both are texts like others. Null ids come after all others, so
    keep_id is null only where a group has no id; of rows that share text and id one stays. A text is
    held whole, a few times its length, by the task that meets it. Other columns are not read,
    whatever they are called; an empty table gives an empty result.
    """
    return _groups(docs, id_col, text_col, []).select(
        F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", F.col("sha").alias("text_sha256")
    )


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that :func:`groups` keeps, with all their columns, texts as they came."""
    return _groups(docs, id_col, text_col, docs.columns).where("kept").select(*[F.col(f"rest.`{c}`").alias(c) for c in docs.columns])
