"""Vectorised pre-tokenization for byte-level BPE, and ids per text from ids per distinct piece.

The public split pattern cuts a text into contractions, runs of letters, of
numbers and of other signs (each with one blank before it if there is one), and
white space. Those cuts depend only on the classes of neighbouring code points,
so they are found for a megabyte of texts at a time. Equal pieces share their
ids: a bounded memory in each worker holds those of pieces met before, compared by their bytes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from . import spans

OTHER, LETTER, NUMBER, BLANK, EDGE = 0, 1, 2, 3, 4
#: White space as Unicode defines it. Fixed values.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None
_values: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of every code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        out = np.fromiter((kind.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[WHITE] = BLANK
        _classes = out
    return _classes


def values() -> np.ndarray:
    """A scrambled 64-bit value for every code point."""
    global _values
    if _values is None:
        _values = spans.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return _values


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start, byte end and 64-bit hash of every piece, in text order; no piece crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    lead = np.flatnonzero((buf & 0xC0) != 0x80)  # where code points begin
    cp = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    n = len(cp)
    first = np.searchsorted(lead, offsets[:-1][offsets[:-1] < offsets[1:]])  # code points that begin rows
    head = np.zeros(n + 1, bool)
    head[first], head[n] = True, True
    c = classes()[cp]
    prev = np.empty(n, np.uint8)
    prev[0], prev[1:] = EDGE, c[:-1]
    prev[head[:-1]] = EDGE
    after = np.empty(n, np.uint8)
    after[-1], after[:-1] = EDGE, c[1:]
    after[head[1:]] = EDGE
    blank = c == BLANK
    start = blank & (prev != BLANK)
    start |= blank & (after != BLANK) & (after != EDGE)  # the last blank before a sign stands alone or goes with it
    joined = np.zeros(n, bool)
    joined[1:] = cp[:-1] == 32
    joined &= prev != EDGE
    start |= ~blank & (c != prev) & ~joined
    mark = np.flatnonzero((cp == 39) & start & (after == LETTER))
    if len(mark):
        pad = np.concatenate([cp, np.zeros(3, np.uint32)])
        own = np.concatenate([c, np.full(3, EDGE, np.uint8)])
        edge = np.concatenate([head, np.ones(3, bool)])
        a, b = pad[mark + 1], pad[mark + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))) & ~edge[mark + 2]
        at, size = mark[one | two], np.where(one, 1, 2)[one | two]
        start[at + 1] = False
        rest = at + 1 + size
        rest = rest[(own[rest] == LETTER) & ~edge[rest]]
        start[rest] = True
    s = np.flatnonzero(start)
    e = np.append(s[1:], n)
    h = spans.span_hash(spans.prefix_of(values()[cp]), s, e)
    at = np.append(lead, len(buf))
    return at[s], at[e], h


class PieceIds:
    """Ids of pieces. ``encode`` gets new distinct pieces and returns ids and lengths;
    ``decode``, if given, gets those and returns bytes and lengths. Beyond about ``most`` pieces
    or ``most_bytes`` of them the memory starts afresh, which costs time and changes nothing."""

    def __init__(self, encode: Callable, decode: Callable | None = None, most: int = 1 << 20, most_bytes: int = 1 << 25):
        self.encode, self.decode, self.most, self.most_bytes = encode, decode, most, most_bytes
        self.clear()

    def clear(self) -> None:
        self.known = spans.SpanTable()
        self.ids, self.raw = spans.Pool(np.int32), spans.Pool(np.uint8)

    def learn(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Make every piece known; returns the slot of each."""
        if len(self.known) > self.most or self.known.bytes.n > self.most_bytes:
            self.clear()
        slot, new = self.known.numbers(buf, start, end, keys)
        if len(new):
            raw = buf.tobytes()
            ids, sizes = self.encode([raw[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)])
            self.ids.append(ids, sizes)
            if self.decode:
                self.raw.append(*self.decode(ids, sizes))
        return slot

    def slots(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of every piece, and the number of pieces before each row (one more at the end)."""
        start, end, keys = pieces(buf, offsets)
        slot = self.learn(buf, start, end, keys) if len(start) else np.zeros(0, np.int64)
        return slot, np.append(np.searchsorted(start, offsets[:-1]), len(start))

    def encode_rows(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and where each row's begin (one more at the end)."""
        slot, upto = self.slots(buf, offsets)
        ids, bounds = self.ids.gather(slot)
        return ids, bounds[upto]
