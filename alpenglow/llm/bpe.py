"""Byte-pair merging of many words at once.

Words lie one after another in a flat symbol array. A round finds, by a segmented minimum, the
best-ranked pair of every word, merges all its leftmost non-overlapping occurrences, and compacts
the arrays; words without a known pair leave. The result is that of merging one pair at a time,
best rank first, leftmost first: where a merge makes a pair of a better rank than its own, the
word's later occurrences wait for the next round.
"""

from __future__ import annotations

import numpy as np

from alpenglow.llm.vector import heads, ordered, ragged, same_spans

NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)


class MergeTable:
    """(left, right) -> rank and merged symbol, in an open-addressing table."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys = np.full(1 << bits, _EMPTY)
        self.rank = np.full(1 << bits, NONE, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            place = at[todo]
            free = self.keys[place] == _EMPTY
            first = np.zeros(len(todo), bool)
            first[np.unique(place, return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.rank[at[put]], self.made[at[put]] = keys[put], rank[put], made[put]
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(keys)
        have = self.keys[at]
        open_ = np.flatnonzero((have != keys) & (have != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            have = self.keys[at[open_]]
            open_ = open_[(have != keys[open_]) & (have != _EMPTY)]
        hit = self.keys[at] == keys
        return np.where(hit, self.rank[at], NONE), self.made[at]


def merge(table: MergeTable, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every word symbols[bounds[i]:bounds[i+1]] to its end; the flat result and its bounds."""
    n_words = len(bounds) - 1
    sym = symbols.astype(np.int32)
    word = np.repeat(np.arange(n_words, dtype=np.int32), np.diff(bounds))
    done_sym, done_word = [], []

    def ranked(at: np.ndarray) -> None:
        """Rank again the pairs that start at ``at``."""
        at = at[(at >= 0) & (at < len(sym) - 1)]
        at_in = at[word[at] == word[at + 1]]
        rank[at] = NONE
        rank[at_in], made[at_in] = table.find(sym[at_in], sym[at_in + 1])

    rank, made = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)
    ranked(np.arange(len(sym) - 1))
    while len(sym):
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, start)
        size = np.diff(np.r_[start, len(sym)])
        if (over := least == NONE).any():
            gone = np.repeat(over, size)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            keep = ~gone
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            least, size = least[~over], size[~over]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(least, size))
        if len(hit) > len(least):  # some word has several: keep every other one of a run, then heed better new pairs
            first = np.r_[True, np.diff(hit) != 1]
            run = np.flatnonzero(first)
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.r_[run, len(hit)]))) % 2
            hit = hit[odd == 0]
            hit = _orderly(table, sym, word, made, rank, hit)
        sym[hit] = made[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        at = hit - np.arange(len(hit))
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        rank[at] = NONE
        ranked(np.stack((at - 1, at), axis=1).ravel())
    if not done_sym:
        return np.zeros(0, np.int32), np.zeros(n_words + 1, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    out = np.zeros(n_words + 1, np.int64)
    np.cumsum(np.bincount(word, minlength=n_words), out=out[1:])
    return sym[order], out


def _orderly(table: MergeTable, sym, word, made, rank, hit: np.ndarray) -> np.ndarray:
    """Drop the occurrences that come, in their word, after one whose merge makes a better-ranked pair."""
    w = word[hit]
    several = np.zeros(len(hit), bool)
    same = w[1:] == w[:-1]
    several[1:] |= same
    several[:-1] |= same
    at = np.flatnonzero(several)
    if not len(at):
        return hit
    i = hit[at]
    bad = np.zeros(len(i), bool)
    new = made[i]
    has = i + 2 < len(sym)
    has[has] = word[i[has] + 2] == word[i[has]]
    bad[has] |= table.find(new[has], sym[i[has] + 2])[0] < rank[i[has]]
    has = i > 0
    has[has] = word[i[has] - 1] == word[i[has]]
    before = sym[np.maximum(i - 1, 0)].copy()
    merged = np.r_[False, (np.diff(i) == 2) & (w[at][1:] == w[at][:-1])]
    before[merged] = new[np.flatnonzero(merged) - 1]
    bad[has] |= table.find(before[has], new[has])[0] < rank[i[has]]
    if not bad.any():
        return hit
    drop = np.zeros(len(hit), bool)
    ww = w[at]
    count = np.cumsum(bad) - bad  # bad ones before, over all words
    base = np.r_[True, ww[1:] != ww[:-1]]
    run = np.flatnonzero(base)
    drop[at] = count - np.repeat(count[run], np.diff(np.r_[run, len(ww)])) > 0
    return hit[~drop]


def unique_words(symbols: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray, exact: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """Indices of distinct words, for every word its place among them, and the number of distinct hashes.

    The words come in the order of their hashes; where equal hashes turn out, symbol by symbol, to be
    of different words, these stand for themselves after all others. Two words of up to ``exact``
    symbols are known to differ in their hashes if they differ.
    """
    order, in_order = ordered(hashes)
    head = heads(in_order)
    first = order[head]
    inverse = np.empty(len(order), np.int64)
    inverse[order] = np.repeat(np.arange(len(head)), np.diff(head, append=len(order)))
    rep = first[inverse]
    bad = length[rep] != length
    open_ = np.flatnonzero((length > exact) & ~bad)
    bad[open_] = ~same_spans(symbols, start[open_], symbols, start[rep[open_]], length[open_])
    n = len(first)
    if bad.any():
        own = np.flatnonzero(bad)
        inverse[own] = n + np.arange(len(own))
        first = np.concatenate((first, own))
    return first, inverse, n


class WordStore:
    """Merged ids of words, kept between batches for the first ``limit`` words that a process meets.

    ``initial(chars, bounds)`` gives the words' symbols and bounds before merging, ``final(symbols,
    bounds)`` what they become after it. Words are found by hash and compared symbol by symbol.
    """

    LONG = 64

    def __init__(self, table: MergeTable, initial, final=None, limit: int = 300_000):
        self.table, self.initial, self.final, self.limit = table, initial, final, limit
        self.hash = np.zeros(0, np.uint64)
        self.char_at, self.n_chars = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id_at, self.n_ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chars, self.ids = np.zeros(0, np.uint32), np.zeros(0, np.int32)

    def encode(self, symbols: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words at ``start``, one word after another, and the number of ids of each."""
        rep, inverse, _ = unique_words(symbols, start, length, hashes)
        at, size, h = start[rep], length[rep], hashes[rep]
        place = np.minimum(np.searchsorted(self.hash, h), max(len(self.hash) - 1, 0))
        known = np.zeros(len(rep), bool)
        if len(self.hash):
            known = (self.hash[place] == h) & (self.n_chars[place] == size)
            k = np.flatnonzero(known)
            known[k] = same_spans(symbols, at[k], self.chars, self.char_at[place[k]], size[k])
        new = np.flatnonzero(~known)
        chars = symbols[ragged(at[new], size[new])]
        char_at = np.zeros(len(new) + 1, np.int64)
        np.cumsum(size[new], out=char_at[1:])
        ids, bounds = merge(self.table, *self.initial(chars, char_at))
        if self.final:
            ids, bounds = self.final(ids, bounds)
        flat = np.concatenate((self.ids, ids))
        id_at, n_ids = np.empty(len(rep), np.int64), np.empty(len(rep), np.int64)
        id_at[known], n_ids[known] = self.id_at[place[known]], self.n_ids[place[known]]
        id_at[new], n_ids[new] = len(self.ids) + bounds[:-1], np.diff(bounds)
        if len(self.hash) < self.limit:
            self._keep(h[new], chars, char_at, size[new], ids, bounds)
        return flat[ragged(id_at[inverse], n_ids[inverse])], n_ids[inverse]

    def _keep(self, h, chars, char_at, size, ids, bounds) -> None:
        ok = np.flatnonzero(size <= self.LONG)
        ok = ok[np.unique(h[ok], return_index=True)[1]]
        ok = ok[~np.isin(h[ok], self.hash)]
        new_ids = np.diff(bounds)[ok]
        all_chars = len(self.chars) + np.cumsum(size[ok]) - size[ok]
        all_ids = len(self.ids) + np.cumsum(new_ids) - new_ids
        self.chars = np.concatenate((self.chars, chars[ragged(char_at[:-1][ok], size[ok])]))
        self.ids = np.concatenate((self.ids, ids[ragged(bounds[:-1][ok], new_ids)]))
        order = np.argsort(joined := np.concatenate((self.hash, h[ok])))
        self.hash = joined[order]
        for name, add in (("char_at", all_chars), ("n_chars", size[ok]), ("id_at", all_ids), ("n_ids", new_ids)):
            setattr(self, name, np.concatenate((getattr(self, name), add))[order])
