"""Operator 1: SentencePiece BPE encoding and decoding, vectorised over all words of a batch.

A text's spaces become U+2581, one more is put before it, and it is cut before each U+2581 that
follows another character: no piece crosses such a place. Distinct words are merged by
:func:`alpenglow.llm.bpe.merge`; their ids are then gathered for all their places. Characters
without a piece become the byte pieces of their UTF-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from alpenglow.llm import bpe
from alpenglow.llm.vector import PrefixHash, offsets, ragged, texts

SPACE = 0x2581
CHARS = 0x110000


class PieceCodec:
    """Encoder and decoder of one SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        normal = [not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i)) for i in range(n)]
        self.size, self.eos = n, lib.eos_id()
        self.byte_id = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        ids = {p: i for i, p in enumerate(pieces) if normal[i]}
        if any("▁" in p.lstrip("▁") for p in ids):
            raise ValueError("a piece has U+2581 after another character; words can't be merged on their own")
        #: Symbols are piece ids, and n + code point for characters without a piece.
        self.char = np.arange(CHARS, dtype=np.int32) + n
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        symbol = lambda s: ids.get(s, n + ord(s) if len(s) == 1 else None)
        scores = np.array([-lib.get_score(ids[p]) for p in ids])
        rank = dict(zip(ids, np.unique(scores, return_inverse=True)[1].tolist()))
        rows = [(a, b, rank[p], i) for p, i in ids.items() for k in range(1, len(p)) if (a := symbol(p[:k])) is not None and (b := symbol(p[k:])) is not None]
        self.table = bpe.MergeTable(*np.array(rows, np.int64).T)
        self.store = bpe.WordStore(self.table, lambda chars, at: (self.char[chars], at), self._bytes)
        # what each id decodes to
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_id[self.byte_id >= 0]] = True
        made = [p.replace("▁", " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte_id):
            made[i] = bytes([b])
        made[lib.unk_id()] = " ⁇ ".encode()
        self.made = made
        self.made_at = offsets(np.array([len(x) for x in made]))
        self.made_flat = np.frombuffer(b"".join(made), np.uint8)
        # decimal names with a space after them, for digests
        names = [b"%d " % i for i in range(n)]
        self.name_at = offsets(np.array([len(x) for x in names]))
        self.name_flat = np.frombuffer(b"".join(names), np.uint8)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (UTF-8) and the bounds of each text's; no begin or end ids."""
        decoded = [d.decode("utf-8", "replace") for d in docs]
        flat = "".join("▁" + t for t in decoded if t)
        symbols = np.frombuffer(flat.encode("utf-32-le"), np.uint32).copy()
        n_chars = np.array([len(t) + 1 if t else 0 for t in decoded], np.int64)
        doc_at = offsets(n_chars)
        if not len(symbols):
            return np.zeros(0, np.int32), np.zeros(len(docs) + 1, np.int64)
        symbols[symbols == 0x20] = SPACE
        space = symbols == SPACE
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[doc_at[:-1][n_chars > 0]] = True
        bounds = np.r_[np.flatnonzero(cut), len(symbols)].astype(np.int64)
        ids, n_ids = self.store.encode(symbols, bounds[:-1], np.diff(bounds), PrefixHash(symbols).span(bounds[:-1], bounds[1:]))
        word_at = np.searchsorted(bounds[:-1], doc_at)
        return ids, offsets(n_ids)[word_at]

    def _bytes(self, sym: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace characters without a piece by byte pieces."""
        unknown = np.flatnonzero(sym >= self.size)
        if not len(unknown):
            return sym, at
        chars, which = np.unique(sym[unknown] - self.size, return_inverse=True)
        coded = [chr(c).encode("utf-8", "surrogatepass") for c in chars.tolist()]
        size, flat = np.array([len(c) for c in coded]), self.byte_id[np.frombuffer(b"".join(coded), np.uint8)]
        count = np.ones(len(sym), np.int64)
        count[unknown] = size[which]
        out = np.repeat(sym, count)
        new = offsets(count)
        out[ragged(new[unknown], size[which])] = flat[ragged(offsets(size)[:-1][which], size[which])]
        return out, new[at]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``: control ids are nothing, one leading space goes, bytes outside UTF-8 become U+FFFD."""
        size = np.diff(self.made_at)[ids]
        raw = self.made_flat[ragged(self.made_at[ids], size)].tobytes()
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._repair(ids)
        real = ids[size > 0]
        return text[1:] if len(real) and not self.is_byte[real[0]] and self.made[real[0]][:1] == b" " and text[:1] == " " else text

    def _repair(self, ids: np.ndarray) -> str:
        """Runs of byte pieces decoded on their own; every byte that belongs to no character is one U+FFFD."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for k in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + k]).decode())
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    k = 1
                at += min(k, len(run) - at) if out[-1] != "�" else 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.made[i]
            else:
                flush()
                out.append(self.made[i].decode())
        flush()
        return "".join(out)

    def names(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by one space."""
        size = np.diff(self.name_at)[ids]
        return self.name_flat[ragged(self.name_at[ids], size)][:-1].tobytes()


@cache
def codec(path: str) -> PieceCodec:
    """One codec a worker process."""
    return PieceCodec(path)


def encode(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>, decoded string)`` of every text, end id last.

    A null text counts as empty: its ids are the end id alone. Ids may be null or repeat; each
    row is encoded on its own. An empty table gives an empty result. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, raw in texts(batches):
            ids, at = c.encode(raw)
            each = [np.append(ids[a:b], np.int32(c.eos)) for a, b in zip(at, at[1:])]
            bounds = offsets(np.diff(at) + 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(each)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array([c.decode(x) for x in each])], names=["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256 of :func:`encode`, without shipping ids between processes.

    Null texts are empty, null or repeated doc_ids stay as they are, extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch, raw in texts(batches):
            ids, at = c.encode(raw)
            n, a_sha, b_sha = [], [], []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                x = np.append(ids[a:b], np.int32(c.eos))
                n.append(len(x))
                a_sha.append(hashlib.sha256(c.names(x)).hexdigest())
                b_sha.append(hashlib.sha256(c.decode(x).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a_sha, pa.string()), pa.array(b_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"], docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
