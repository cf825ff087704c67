"""Word BPE with end-of-word symbols over a ``tokenizers`` file, vectorised over the words of a batch.

The tokenizer lower-cases, drops white space and cuts a text into letter runs, single digits, runs
of other characters and English contractions; each is merged on its own. Texts of characters whose
case, class and composition are the same in any Unicode version take the vectorised way; the
others, and those that hold a special token's string, go through the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import cache
from pathlib import Path

import numpy as np

from alpenglow.llm import bpe
from alpenglow.llm.vector import PrefixHash, offsets

#: Outside these the library decides: controls that regular expressions class differently, U+0130, combining marks, other scripts.
OTHER = re.compile("[^\x00-\x1b\x20-\u012f\u0131-\u017f\u2010-\u2027\u2030-\u205e\u20ac]")
LETTER, DIGIT, WHITE, REST = 0, 1, 2, 3
QUOTE = 0x27


def _classes() -> np.ndarray:
    out = np.full(0x2100, REST, np.int8)
    for c in range(len(out)):
        kind = unicodedata.category(chr(c))[0]
        out[c] = WHITE if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else LETTER if kind == "L" else DIGIT if kind == "N" else REST
    return out


class WordCodec:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.table = bpe.MergeTable(*np.array([(vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)], np.int64).T)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]))
        # bytes as characters: printable ones are themselves, the rest follow U+0100 in order
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int32)
        self.classes = _classes()
        self.store = bpe.WordStore(self.table, self._bytes)

    def encode(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts (UTF-8) and each text's bounds; no special tokens are added."""
        decoded = [d.decode("utf-8", "replace") for d in docs]
        hard = [k for k, t in enumerate(decoded) if OTHER.search(t) or self.special.search(t)]
        easy = decoded if not hard else [t for k, t in enumerate(decoded) if k not in set(hard)]
        ids, at = self._vectorised(easy)
        if not hard:
            return ids, at
        parts, n, hard_at = [], 0, set(hard)
        for k, t in enumerate(decoded):
            if k in hard_at:
                parts.append(np.array(self.library.encode(t, add_special_tokens=False).ids, np.int32))
            else:
                parts.append(ids[at[n] : at[n + 1]])
                n += 1
        return np.concatenate(parts).astype(np.int32), offsets(np.array([len(p) for p in parts]))

    def _vectorised(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        symbols = np.frombuffer("".join(t.lower() + "\n" for t in docs).encode("utf-32-le"), np.uint32)
        doc_at = offsets(np.array([len(t) + 1 for t in docs], np.int64))
        if not len(symbols):
            return np.zeros(0, np.int32), np.zeros(len(docs) + 1, np.int64)
        kind = self.classes[symbols]
        white = kind == WHITE
        start = kind == DIGIT
        start[0] = True
        start[1:] |= kind[1:] != kind[:-1]
        quote = np.flatnonzero(symbols == QUOTE)
        quote = quote[(quote == 0) | (kind[quote - 1] != REST)]
        if len(quote):
            after = lambda k: np.where(quote + k < len(symbols), symbols[np.minimum(quote + k, len(symbols) - 1)], 0)
            a, b = after(1), after(2)
            pair = lambda x, y: (a == ord(x)) & (b == ord(y))
            long = pair("r", "e") | pair("v", "e") | pair("l", "l")
            short = np.isin(a, [ord(c) for c in "stmd"])
            for has, size in ((short, 2), (long, 3)):
                q = quote[has]
                for k in range(1, size):
                    start[q + k] = False
                start[q + size] = True
        start &= ~white
        first = np.flatnonzero(start)
        stops = np.flatnonzero(start | white)
        length = stops[np.searchsorted(stops, first, "right")] - first
        if not len(first):
            return np.zeros(0, np.int32), np.zeros(len(docs) + 1, np.int64)
        ids, n_ids = self.store.encode(symbols, first, length, PrefixHash(symbols).span(first, first + length))
        return ids, offsets(n_ids)[np.searchsorted(first, doc_at)]

    def _bytes(self, chars: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the words' UTF-8 bytes; characters are below U+10000 here."""
        width = 1 + (chars >= 0x80).astype(np.int64) + (chars >= 0x800)
        at = offsets(width)
        raw = np.empty(at[-1], np.int64)
        raw[at[:-1]] = np.where(width == 1, chars, np.where(width == 2, 0xC0 | (chars >> 6), 0xE0 | (chars >> 12)))
        raw[at[1:][width > 1] - 1] = 0x80 | (chars[width > 1] & 0x3F)
        raw[at[:-1][width > 2] + 1] = 0x80 | ((chars[width > 2] >> 6) & 0x3F)
        ends = at[bounds][1:] - 1
        sym = self.inner[raw]
        sym[ends] = self.last[raw[ends]]
        return sym, at[bounds]


@cache
def codec(path: str) -> WordCodec:
    """One codec a worker process."""
    return WordCodec(path)
