"""Vectorised text primitives on Arrow string columns: words, lines and rolling hashes.

All arithmetic wraps modulo 2**64. Hashes depend on content only, never on position, process or
platform, so two executors always agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASES = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_STEPS = (U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_table(seed: int) -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64((seed + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


_TABLES = (_byte_table(0), _byte_table(1))
_POWERS = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def _powers(n: int, seed: int) -> np.ndarray:
    table = _POWERS[seed]
    if len(table) < n:
        size = max(n, 2 * len(table), 256)
        table = np.full(size, _BASES[seed], dtype=U64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        _POWERS[seed] = table
    return table


@dataclass
class Texts:
    """UTF-8 bytes of a column of strings; document i is data[offsets[i]:offsets[i + 1]]."""

    data: np.ndarray
    offsets: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Texts:
        """Null becomes the empty text."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, values = column.buffers()
        off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(values, dtype=np.uint8) if values is not None else np.zeros(0, np.uint8)
        return cls(data[off[0] : off[-1]], off - off[0])

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def doc(self, i: int) -> np.ndarray:
        return self.data[self.offsets[i] : self.offsets[i + 1]]


def slices(texts: Texts, most: int) -> list[tuple[int, int]]:
    """Runs of documents of about `most` bytes each; one longer document is a run of its own."""
    out, i, n = [], 0, len(texts)
    while i < n:
        j = int(np.searchsorted(texts.offsets, texts.offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        out.append((i, j))
        i = j
    return out


def part(texts: Texts, i: int, j: int) -> Texts:
    off = texts.offsets[i : j + 1]
    return Texts(texts.data[off[0] : off[-1]], off - off[0])


@dataclass
class Words:
    """Words of all documents in order; document i owns words first[i]:first[i + 1]."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def words(texts: Texts, separators: np.ndarray = SPACE) -> Words:
    """Maximal runs of bytes outside `separators` within each document (the pattern [^sep]+)."""
    data, off = texts.data, texts.offsets
    if not len(data):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    inside = ~separators[data]
    edge = np.zeros(len(data), dtype=bool)
    cut = off[:-1]
    edge[cut[cut < len(data)]] = True
    head = inside.copy()
    head[1:] &= ~inside[:-1] | edge[1:]
    tail = inside
    tail[:-1] &= ~inside[1:] | edge[1:]
    starts, ends = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return Words(starts, ends, np.searchsorted(starts, off))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of each disjoint ascending span of bytes; empty spans hash to a constant."""
    out = np.zeros(len(starts), dtype=U64)
    length = ends - starts
    full = np.flatnonzero(length > 0)
    if len(full):
        s, n = starts[full], length[full]
        begin = np.cumsum(n) - n
        within = np.arange(int(n.sum()), dtype=np.int64)
        within -= np.repeat(begin, n)
        picked = data[np.repeat(s, n) + within]
        value = _TABLES[seed][picked]
        value *= _powers(int(n.max()), seed)[within]
        out[full] = np.add.reduceat(value, begin)
    out += length.astype(U64) * U64(0xE7037ED1A0B428DB)
    return mix64(out)


def window_hash(item: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of items i..i+k-1 for each i; windows may cross documents, callers mask those. By doubling."""
    n = len(item) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    power, have, width, acc, done = item, int(_STEPS[seed]), 1, None, 0
    rest = k
    while rest:
        if rest & 1:
            if acc is None:
                acc, done = power, width
            else:
                m = len(item) - (done + width) + 1
                acc = acc[:m] * U64(have) + power[done : done + m]
                done += width
        rest >>= 1
        if rest:
            m = len(power) - width
            power = power[:m] * U64(have) + power[width : width + m]
            have = have * have & 0xFFFFFFFFFFFFFFFF
            width *= 2
    return mix64(acc[:n])


def window_starts(first: np.ndarray, k: int, total: int) -> np.ndarray:
    """Mask over word positions at which a window of k words fits in its document."""
    ok = np.zeros(total, dtype=bool)
    n = np.diff(first) - k + 1
    keep = n > 0
    s, n = first[:-1][keep], n[keep]
    if len(s):
        mark = np.zeros(total + 1, dtype=np.int32)
        np.add.at(mark, s, 1)
        np.add.at(mark, s + n, -1)
        ok = np.cumsum(mark[:-1]) > 0
    return ok


def covered(hit: np.ndarray, k: int) -> np.ndarray:
    """Positions inside a window of k that starts at a True of `hit`."""
    mark = np.zeros(len(hit) + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    mark[at] += 1
    np.add.at(mark, np.minimum(at + k, len(hit)), -1)
    return np.cumsum(mark[:-1]) > 0


def minima(order: np.ndarray, width: int) -> np.ndarray:
    """Minimum of order[i:i+width] for each full window, by doubling."""
    out, have = order, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        extra = width - have
        out = np.minimum(out[:-extra], out[extra:])
    return out


def owners(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys, their smallest doc, and whether two different docs hold them."""
    if not len(keys):
        return keys, doc, np.zeros(0, dtype=bool)
    by = np.lexsort((doc, keys))
    k, d = keys[by], doc[by]
    head = np.r_[True, k[1:] != k[:-1]]
    at = np.flatnonzero(head)
    last = np.r_[at[1:], len(k)] - 1
    return k[at], d[at], d[last] != d[at]


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """values in the sorted table."""
    if not len(table):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values
