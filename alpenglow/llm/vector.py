"""Numpy helpers shared by the operators: ragged gathers, prefix hashes, batch cutting."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Arrow's own pools keep what they once held; a worker that is used again would pile that up
pa.set_memory_pool(pa.system_memory_pool())

#: Odd multipliers of the two prefix polynomial hashes (mod 2^64) and of the final mixing.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

#: Bytes of text worked on at once; the arrays of a block take some 40 times as much.
BLOCK = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the entropy of ``h`` (uint64) over all its bits; a bijection."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(MIX[0])
    h ^= h >> np.uint64(33)
    h *= np.uint64(MIX[1])
    h ^= h >> np.uint64(33)
    return h


def unmix(h: np.ndarray) -> np.ndarray:
    """The inverse of :func:`mix`."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(pow(MIX[1], -1, 1 << 64))
    h ^= h >> np.uint64(33)
    h *= np.uint64(pow(MIX[0], -1, 1 << 64))
    h ^= h >> np.uint64(33)
    return h


class PrefixHash:
    """Polynomial hashes of any span of a symbol array in O(1) from its prefix sums.

    ``Q[i] = sum(s[j] * B**j for j < i)`` mod 2^64; a span's hash is its difference of
    prefix sums times the inverse power of its start, so it does not depend on the place.
    """

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, symbols: np.ndarray, which: int = 0):
        n = len(symbols)
        power, self.inverse = self.powers(n, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((symbols.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            size = -(-n // (1 << 18)) * (1 << 18)  # not doubled: every worker keeps them
            base = BASES[which]
            pair = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.ones(size, np.uint64)
                done, step = 1, b
                while done < size:  # p[done:2*done] = p[:done] * b**done
                    take = min(done, size - done)
                    p[done : done + take] = p[:take] * np.uint64(step)
                    step = step * step % (1 << 64)
                    done += take
                pair.append(p)
            have = cls._powers[which] = (pair[0], pair[1])
        return have

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Mixed hashes of the spans, which also depend on their lengths."""
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + np.uint64(BASES[1]) * (end - start).astype(np.uint64))

    def equal_length(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Unmixed hashes, to compare spans of one length."""
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]


def trim() -> None:
    """Gives freed memory back to the system, powers included, which are soon made again.

    The C library keeps what arrays leave between others; a worker outlives its task, and would hold that beside the next one's.
    """
    PrefixHash._powers.clear()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc
        give(0)


def offsets(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every span, one span after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = np.repeat(starts - (ends - lengths), lengths)
    return shift + np.arange(total, dtype=shift.dtype if total else np.int64)


def heads(ordered_: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    new = np.ones(len(ordered_), bool)
    new[1:] = ordered_[1:] != ordered_[:-1]
    return np.flatnonzero(new)


def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the keys (none negative) in their order, equal ones as they come, and the keys in this order.

    One sort of keys with their places in the low bits, some three times as quick as ``argsort``. Where the
    keys leave too few bits for that, only their high ones are sorted at first, and what these leave open after.
    """
    keys = keys.astype(np.uint64, copy=False)
    if not len(keys):
        return np.zeros(0, np.int64), keys
    least = keys.min()
    free = 64 - int(keys.max() - least).bit_length()
    low = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
    both = (((keys - least) << np.uint64(min(free, 63))) & ~low) | np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).view(np.int64)
    out = keys[order]
    if (out[1:] < out[:-1]).any():
        again = np.argsort(out, kind="stable")  # quick on what is nearly in order
        order, out = order[again], out[again]
    return order, out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as byte planes, of which the even ones compress well."""
    return len(arrays[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(a[:, None].view(np.uint8).T).tobytes() for a in map(np.ascontiguousarray, arrays))


def unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of :func:`pack`, of these types."""
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        planes = np.frombuffer(data, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        values = np.empty(n, kind)
        each = values.view(np.uint8)
        for k, plane in enumerate(planes):
            each[k :: kind.itemsize] = plane
        out.append(values)
        at += n * kind.itemsize
    return out


def eights(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte of ``x`` on, as one number; zeros follow the last."""
    raw = np.concatenate((np.ascontiguousarray(x).view(np.uint8), np.zeros(8, np.uint8)))
    return np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))


MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def same_spans(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of the spans ``x[a:a+length]`` equal ``y[b:b+length]``, eight bytes at a time; x and y are of one type."""
    size = x.itemsize
    ex = eights(x)
    ey = ex if y is x else eights(y)
    same = np.ones(len(a), bool)
    todo = np.flatnonzero(length > 0)
    i, j, left = a[todo] * size, b[todo] * size, length[todo] * size
    for _ in range(64):
        mask = MASK[np.minimum(left, 8)]
        ok = (ex[i] & mask) == (ey[j] & mask)
        same[todo[~ok]] = False
        go = ok & (left > 8)
        todo, i, j, left = todo[go], i[go] + 8, j[go] + 8, left[go] - 8
        if not len(todo):
            return same
    for t in todo.tolist():  # long ones
        same[t] = np.array_equal(x[a[t] : a[t] + length[t]], y[b[t] : b[t] + length[t]])
    return same


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts of equal shares of the hash range (uint64), in order."""
    return ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def segment_sum(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]; empty segments give 0."""
    sums = np.zeros(len(bounds) - 1, values.dtype)
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    if len(full):
        sums[full] = np.add.reduceat(values[: bounds[-1]], bounds[full])
    return sums


def texts(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut Arrow batches into slices of about ``size`` bytes of text, with the text as UTF-8 (null: empty). Memory is trimmed at every batch."""
    trim()
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
        lengths = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1])
        block = np.cumsum(lengths) // size
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]
        del batch, col, lengths, block
        trim()
