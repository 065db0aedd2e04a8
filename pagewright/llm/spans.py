"""Vectorised byte-span work on many texts at once: words, hashes, n-grams, sums per text."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=U) * U(_ODD))
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of an odd base modulo 2**64, and of its inverse."""
    global _powers
    if len(_powers[0]) <= n:
        size = 1 << int(n + 1).bit_length()
        out = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        _powers = (out[0], out[1])
    return _powers


def prefix_of(values: np.ndarray) -> np.ndarray:
    """Running polynomial hash of 64-bit symbol values."""
    p, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=out[1:])
    return out


def prefix(buf: np.ndarray) -> np.ndarray:
    return prefix_of(_BYTE[buf])


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal wherever the bytes are. Other spans may share one: see ``groups`` and ``SpanTable``."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(U) * U(_ODD))


def owners(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The row that each position belongs to."""
    return np.searchsorted(offsets, at, "right") - 1


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every maximal run without ASCII white space."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[buf]
    cut = np.zeros(len(buf) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(buf), bool)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty(len(buf), bool)
    after[-1] = False
    after[:-1] = solid[1:]
    start = np.flatnonzero(solid & (~before | cut[:-1]))
    end = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return start, end, owners(offsets, start)


def lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line between line feeds; empty rows have one empty line."""
    nl = np.flatnonzero(buf == 10)
    row = owners(offsets, nl)
    start = np.concatenate([offsets[:-1], nl + 1])
    end = np.concatenate([nl, offsets[1:]])
    who = np.concatenate([np.arange(len(offsets) - 1), row])
    ends_who = np.concatenate([row, np.arange(len(offsets) - 1)])
    a, b = np.lexsort((start, who)), np.lexsort((end, ends_who))
    return start[a], end[b], who[a]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of per-byte values for each row."""
    c = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=c[1:])
    return c[offsets[1:]] - c[offsets[:-1]]


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def same_spans(a: np.ndarray, start: np.ndarray, end: np.ndarray, b: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """For each pair of spans, one of ``a`` and one of ``b``, whether their bytes are equal."""
    size = end - start
    out = size == end2 - start2
    for i in np.flatnonzero(out & (size > _LONG)).tolist():
        out[i] = np.array_equal(a[start[i] : end[i]], b[start2[i] : end2[i]])
    short = np.flatnonzero(out & (size <= _LONG) & (size > 0))
    stops = np.cumsum(size[short])
    lo = 0
    while lo < len(short):  # some bytes at a time, as each takes an index
        hi = max(lo + 1, int(np.searchsorted(stops, (stops[lo - 1] if lo else 0) + _CHUNK, "right")))
        who = short[lo:hi]
        n = size[who]
        ends = np.cumsum(n)
        inside = np.arange(ends[-1], dtype=np.int64)
        differ = a[inside + np.repeat(start[who] - (ends - n), n)] != b[inside + np.repeat(start2[who] - (ends - n), n)]
        if differ.any():
            out[who] = ~np.logical_or.reduceat(differ, ends - n)
        lo = hi
    return out


_LONG, _CHUNK = 1 << 12, 1 << 20


def groups(keys: np.ndarray, same: Callable, name: Callable) -> tuple[np.ndarray, np.ndarray]:
    """The class of equals of each element, and whether an earlier element is in it.

    Equal hashes only bring elements together: ``same(i, j)`` confirms neighbours, and
    where it does not, ``name(i)`` tells the elements of one hash apart.
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    repeat = np.zeros(len(k), bool)
    repeat[1:] = k[1:] == k[:-1]
    at = np.cumsum(~repeat) - 1
    group, later = np.empty(len(k), np.int64), np.empty(len(k), bool)
    group[order], later[order] = at, repeat
    joined = np.flatnonzero(repeat)
    sure = same(order[joined - 1], order[joined])
    if not sure.all():
        fresh = int(at[-1]) + 1
        for g in np.unique(at[joined[~sure]]).tolist():
            known: dict = {}
            for i in order[np.searchsorted(at, g) : np.searchsorted(at, g, "right")].tolist():
                x = name(i)
                later[i] = x in known
                if x not in known:
                    known[x] = g if not known else fresh
                    fresh += known[x] == fresh
                group[i] = known[x]
    return group, later


def in_row(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashes that differ from row to row, so that one sort serves many rows."""
    return mix(hashes + (rows.astype(U) + U(1)) * U(_BASE))


def grams(buf: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each position on, packed; positions near the end hold fewer."""
    out = buf.astype(U)
    for k in range(1, n):
        out[:-k] |= buf[k:].astype(U) << U(8 * k)
    return out


class Pool:
    """Runs of values, numbered in the order they came."""

    def __init__(self, kind: type):
        self.values, self.n = np.zeros(1024, kind), 0
        self.at, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def append(self, values: np.ndarray, sizes: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.values):
            grown = np.zeros(max(need, 2 * len(self.values)), self.values.dtype)
            grown[: self.n] = self.values[: self.n]
            self.values = grown
        self.values[self.n : need] = values
        self.at = np.concatenate([self.at, self.n + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size, sizes])
        self.n = need

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs of these numbers one after the other, and where each begins (one more at the end)."""
        at, size = self.at[slots], self.size[slots]
        bounds = np.concatenate([[0], np.cumsum(size)])
        return self.values[np.repeat(at - bounds[:-1], size) + np.arange(bounds[-1])], bounds


class SpanTable:
    """Numbers for distinct byte spans, in the order they came.

    A 64-bit hash finds the number, then the bytes are compared. Spans whose hash
    belongs to other bytes have their numbers by their bytes.
    """

    def __init__(self):
        self.hash, self.slot = np.zeros(0, U), np.zeros(0, np.int64)
        self.bytes = Pool(np.uint8)
        self.odd: dict[bytes, int] = {}

    def __len__(self) -> int:
        return len(self.bytes.at)

    def numbers(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each span, and which spans brought new numbers, in their order."""
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        pos = np.searchsorted(self.hash, distinct)
        known = np.zeros(len(distinct), bool)
        inside = pos < len(self.hash)
        known[inside] = self.hash[pos[inside]] == distinct[inside]
        new = np.flatnonzero(~known)
        fresh = where[new]
        if len(new):
            self.hash, self.slot = np.insert(self.hash, pos[new], distinct[new]), np.insert(self.slot, pos[new], len(self) + np.arange(len(new)))
            self._append(buf, start[fresh], end[fresh])
            pos = np.searchsorted(self.hash, distinct)
        out = self.slot[pos][back]
        at, more = self.bytes.at[out], []
        for i in np.flatnonzero(~same_spans(buf, start, end, self.bytes.values, at, at + self.bytes.size[out])).tolist():
            raw = buf[start[i] : end[i]].tobytes()
            if raw not in self.odd:
                self.odd[raw] = len(self)
                self._append(buf, start[i : i + 1], end[i : i + 1])
                more.append(i)
            out[i] = self.odd[raw]
        return out, np.concatenate([fresh, np.array(more, np.int64)])

    def _append(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        size = end - start
        first = np.cumsum(size) - size
        self.bytes.append(buf[np.repeat(start - first, size) + np.arange(int(size.sum()))], size)
