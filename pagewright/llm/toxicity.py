"""Toxicity: subsequence string kernel, Nyström landmarks, linear support vector machine.

The kernel counts common subsequences of ``LENGTH`` letters, each weighted down by
a decay for every letter it spans, so ``idiot``, ``id.iot`` and ``idi0ot`` still
share most of them. A text is seen as its units: the letters and digits of its words, and
of runs of single signs (``i d i o t``) taken together. Every unit of every labelled text
trains the machine with its text's label; a text is toxic if some unit is, so units of
toxic texts that the machine finds clean count as clean in the next round. A text's
score comes from its strongest units, calibrated on texts kept apart.

Neighbouring words are scored joined, too (``id iot``, ``st u pid``), where they can be the
beginning, middle and end of a unit that the machine learnt as toxic, one foreign sign allowed in each.

Each distinct unit is scored once and remembered, so the kernel's cost follows the
vocabulary, not the length of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import spans
from .common import fold, slices, table, with_workers
from .quality import labelled

#: Labelled rows of each class that the fit reads at most; labels of fold 2 of 4 are never learnt.
ROWS_PER_CLASS, FOLDS, HELD_OUT = 1500, 4, 2
THRESHOLD = 0.3
#: Subsequence length, decay per spanned letter, landmarks, rounds of training.
LENGTH, DECAY, LANDMARKS, ROUNDS = 3, 0.6, 256, 4
#: Made-up spoilt forms of each unit surely toxic that the last round learns from as well.
VIRTUAL = 4
#: Value from which a unit of a toxic text goes on counting as toxic.
SURE = 0.3
#: The kernel reads units in windows of so many bytes, half of each shared with the next; longer units have more windows.
SIGNS = 16
#: Neighbouring words that are joined at most; pieces of at least so many bytes may hold a foreign sign.
JOINED, SPOILT = 4, 3
#: Units remembered in a worker before its memory starts afresh.
REMEMBERED = 1 << 20
#: Units that the kernel compares with the landmarks at a time.
BLOCK = 4096
U = np.uint64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are no part of a unit: ASCII signs. Bytes of other letters stay.
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


_places: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _choices(length: int) -> tuple[np.ndarray, np.ndarray]:
    """All increasing choices of ``LENGTH`` positions, and the decay for the span of each."""
    if length not in _places:
        at = np.array(list(combinations(range(length), LENGTH)), np.int64).reshape(-1, LENGTH)
        _places[length] = at, (DECAY ** (at[:, -1] - at[:, 0] + 1)).astype(np.float32)
    return _places[length]


def subsequences(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, packed letters and summed decay of every distinct subsequence of every row.

    Rows are codes padded by zeros at the end. These are the kernel's explicit features:
    the kernel of two rows is the sum of products over the subsequences they share.
    """
    size = (rows > 0).sum(axis=1)
    owners, keys, weights = [], [], []
    for length in np.unique(size[size >= LENGTH]).tolist():
        at, decay = _choices(length)
        who = np.flatnonzero(size == length)
        part = rows[who].astype(np.uint64)
        key = np.zeros((len(who), len(at)), np.uint64)
        for q in range(LENGTH):
            key |= part[:, at[:, q]] << np.uint64(8 * q)
        order = np.argsort(key, axis=1, kind="stable")
        key = np.take_along_axis(key, order, axis=1)
        first = np.ones(key.shape, bool)
        first[:, 1:] = key[:, 1:] != key[:, :-1]
        begin = np.flatnonzero(first)
        owners.append(who[begin // len(at)])
        keys.append(key.ravel()[begin])
        weights.append(np.add.reduceat(decay[order].ravel(), begin))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.float32)
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


class Plain:
    """Several texts as their letters and digits: one buffer, words as spans of it."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        low = _LOWER[buf]
        start, end, row = spans.words(low, offsets)
        kept = ~_SIGN[low]
        upto = np.concatenate([[0], np.cumsum(kept)])
        start, end = upto[start], upto[end]
        some = end > start
        self.buf, self.start, self.end, self.row = low[kept], start[some], end[some], row[some]
        self.prefix = spans.prefix(self.buf)

    def keys(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return spans.span_hash(self.prefix, start, end)

    def units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of every unit of ``LENGTH`` bytes or more; a long one gives a span for each of its windows."""
        lead = np.concatenate([[0], np.cumsum((self.buf & 0xC0) != 0x80)])
        single = (lead[self.end] - lead[self.start]) == 1
        beside = np.zeros(len(single), bool)
        beside[1:] = single[1:] & single[:-1] & (self.row[1:] == self.row[:-1])
        first = np.flatnonzero(~beside)
        start, end, row = self.start[first], self.end[np.append(first[1:], len(beside)) - 1] if len(first) else self.end[:0], self.row[first]
        size = end - start
        n = np.where(size <= SIGNS, 1, -(-(size - SIGNS // 2) // (SIGNS // 2)))
        who = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        start = start[who] + step * (SIGNS // 2)
        end = np.minimum(end[who], start + SIGNS)
        keep = end - start >= LENGTH
        return start[keep], end[keep], row[who][keep]

    def rows(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return padded(self.buf, start, end)


def padded(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Spans of at most ``SIGNS`` bytes as rows, zeros behind."""
    at = start[:, None] + np.arange(SIGNS)
    return np.where(at < end[:, None], np.append(buf, 0)[np.minimum(at, len(buf))], 0).astype(np.uint8)


class Landmarks:
    """Landmark rows by the subsequences they hold: the kernel with them is a sparse product."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows
        owner, key, weight = subsequences(rows)
        self.keys, at = np.unique(key, return_inverse=True)
        self.table = np.zeros((len(self.keys), len(rows)), np.float32)
        self.table[at, owner] = weight
        self.table /= np.maximum(np.sqrt((self.table**2).sum(axis=0)), 1e-9)

    def shared(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, place and normalised weight of the rows' subsequences that some landmark holds."""
        owner, key, weight = subsequences(rows)
        norm = np.sqrt(np.maximum(np.bincount(owner, weight**2, minlength=len(rows)), 1e-18))
        at = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return owner[hit], at[hit], weight[hit] / norm[owner[hit]]

    def kernel(self, rows: np.ndarray) -> np.ndarray:
        """Normalised kernel of every row with every landmark."""
        out = np.zeros((len(rows), len(self.rows)), np.float32)
        for lo in range(0, len(rows), 512):
            owner, at, weight = self.shared(rows[lo : lo + 512])
            order = np.argsort(owner, kind="stable")
            if len(order):
                first = np.flatnonzero(np.diff(owner[order], prepend=-1))
                out[lo + owner[order][first]] = np.add.reduceat(weight[order, None] * self.table[at[order]], first, axis=0)
        return out


class Parts:
    """Which learnt toxic units a word can begin, lie inside of, or end: three sets of bits for each word.

    Units share bits beyond 64 of them, so a set may say too much, never too little.
    """

    def __init__(self, rows: np.ndarray):
        rng = np.random.default_rng(7)
        self.factor = rng.integers(1, 1 << 63, SIGNS, np.uint64) * U(2) + U(1)
        size = (rows > 0).sum(axis=1)
        self.most = int(size.max(initial=0))
        self.tables = []
        for kind in range(3):
            keys, bits = [np.zeros(0, U)], [np.zeros(0, U)]
            for a in range(SIGNS):
                for n in range(1, SIGNS):
                    who = np.flatnonzero(a + n <= size)
                    if kind == 0:
                        who = who[(a == 0) & (n < size[who])]
                    elif kind == 2:
                        who = who[(a + n == size[who]) & (a > 0)]
                    if len(who):
                        part = np.zeros((len(who), SIGNS), np.uint8)
                        part[:, :n] = rows[who, a : a + n]
                        keys.append(self.hash(part))
                        bits.append(U(1) << (who % 64).astype(U))
            keys, bits = np.concatenate(keys), np.concatenate(bits)
            distinct, back = np.unique(keys, return_inverse=True)
            mask = np.zeros(len(distinct), U)
            np.bitwise_or.at(mask, back, bits)
            self.tables.append((distinct, mask))

    def hash(self, rows: np.ndarray) -> np.ndarray:
        return (rows.astype(U) * self.factor).sum(axis=1, dtype=U)

    def bits(self, rows: np.ndarray) -> np.ndarray:
        """The three sets of each word, given as padded rows; of words with a foreign sign, too."""
        size = (rows > 0).sum(axis=1)
        out = np.zeros((len(rows), 3), U)
        where = np.arange(len(rows))
        variants = [(where, self.hash(rows))]
        for k in range(int(size.max(initial=0))):
            who = where[(size > k) & (size >= SPOILT)]
            less = np.concatenate([rows[who, :k], rows[who, k + 1 :], np.zeros((len(who), 1), np.uint8)], axis=1)
            variants.append((who, self.hash(less)))
        for who, key in variants:
            for kind, (known, mask) in enumerate(self.tables):
                if len(known):
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = known[at] == key
                    out[who[hit], kind] |= mask[at[hit]]
        return out


class Model:
    """Landmarks, the machine over their kernel map, and the calibration from units to texts."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float, parts: Parts, text: np.ndarray):
        self.landmarks, self.bias, self.parts, self.text = landmarks, bias, parts, text
        #: The machine is linear in the kernel's features, so it folds into one weight per subsequence.
        self.fold = (landmarks.table @ weights).astype(np.float32)
        self.forget()

    def forget(self) -> None:
        self.known, self.value, self.bits = spans.SpanTable(), np.zeros(0, np.float32), np.zeros((0, 3), U)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "value", "bits")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def margins(self, rows: np.ndarray) -> np.ndarray:
        """The machine's value of each padded row."""
        out = np.full(len(rows), self.bias, np.float32)
        for lo in range(0, len(rows), BLOCK):
            owner, at, weight = self.landmarks.shared(rows[lo : lo + BLOCK])
            out[lo : lo + BLOCK] += np.bincount(owner, weight * self.fold[at], minlength=min(BLOCK, len(rows) - lo)).astype(np.float32)
        return out

    def learn(self, p: Plain, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Numbers of spans of at most ``SIGNS`` bytes; new ones get their value and bits."""
        slot, new = self.known.numbers(p.buf, start, end, p.keys(start, end))
        if len(new):
            rows = p.rows(start[new], end[new])
            self.value = np.concatenate([self.value, self.margins(rows)])
            self.bits = np.concatenate([self.bits, self.parts.bits(rows)])
        return slot

    def joinable(self, p: Plain) -> tuple[np.ndarray, np.ndarray]:
        """First and last of each run of two to ``JOINED`` words that can make up a learnt toxic unit."""
        size = p.end - p.start
        short = np.flatnonzero(size <= SIGNS)
        bits = np.zeros((len(size), 3), U)
        slot = self.learn(p, p.start[short], p.end[short])
        bits[short] = self.bits[slot]
        first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = np.flatnonzero(bits[:-1, 0])
        live = bits[at, 0]
        for k in range(1, JOINED):
            inside = at + k < len(size)
            at, live = at[inside], live[inside]
            long = p.end[at + k] - p.start[at]
            near = (p.row[at + k] == p.row[at]) & (long <= min(SIGNS, self.parts.most + k + 1))
            at, live, long = at[near], live[near], long[near]
            whole = ((live & bits[at + k, 2]) != 0) & (long >= LENGTH)
            first.append(at[whole])
            last.append(at[whole] + k)
            live = live & bits[at + k, 1]
            at, live = at[live != 0], live[live != 0]
        return np.concatenate(first), np.concatenate(last)

    def joined(self, p: Plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, numbers and values of joined words that the machine finds toxic, more so than each word alone.

        Of joined words that overlap the strongest count.
        """
        first, last = self.joinable(p)
        slot = self.learn(p, p.start[first], p.end[last])
        hot = self.value[slot] > 0
        first, last, slot = first[hot], last[hot], slot[hot]
        if not len(first):
            return first, slot, np.zeros(0)
        value, alone = self.value[slot], np.full(len(first), -np.inf)
        for k in range(JOINED):
            at = np.minimum(first + k, last)
            sized = p.end[at] - p.start[at] <= SIGNS
            own = self.learn(p, p.start[at[sized]], p.end[at[sized]])
            alone[sized] = np.maximum(alone[sized], self.value[own])
        more = value > alone
        first, slot, value = first[more], slot[more], value[more]
        order = np.lexsort((-value, first))
        first, slot, value = first[order], slot[order], value[order]
        top = np.ones(len(first), bool)
        top[1:] = first[1:] != first[:-1]
        first, slot, value = first[top], slot[top], value[top]
        strength = np.full(len(p.start) + 2 * JOINED, -np.inf)
        strength[first + JOINED] = value
        keep = np.ones(len(first), bool)
        rows = np.concatenate([np.full(JOINED, -1), p.row, np.full(JOINED, -1)])
        row = p.row[first]
        for k in range(1, JOINED):
            for side, ahead in ((first + JOINED + k, True), (first + JOINED - k, False)):
                other = np.where(rows[side] == row, strength[side], -np.inf)
                keep &= (value >= other) if ahead else (value > other)
        return p.row[first[keep]], slot[keep], value[keep]

    def text_features(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: its three highest values of different units, the soft number of toxic ones, and that for 100 units."""
        if len(self.known) > REMEMBERED:
            self.forget()
        n = len(offsets) - 1
        out = np.zeros((n, 5))
        out[:, :3] = -2.0
        p = Plain(buf, offsets)
        start, end, row = p.units()
        slot = self.learn(p, start, end)
        whole = np.bincount(row, minlength=n)
        more, extra, _ = self.joined(p)
        row, slot = np.concatenate([row, more]), np.concatenate([slot, extra])
        if not len(row):
            return out
        v = np.clip(self.value[slot], -2, 2).astype(np.float64)
        soft = np.bincount(row, 1 / (1 + np.exp(-6 * v)), minlength=n)
        pair = np.unique((row << 32) | slot)
        row, v = pair >> 32, np.clip(self.value[pair & 0xFFFFFFFF], -2, 2).astype(np.float64)
        order = np.lexsort((-v, row))
        r = row[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        for k in range(3):
            at = order[rank == k]
            out[row[at], k] = v[at]
        out[:, 3] = np.log1p(soft)
        out[:, 4] = np.log1p(100 * soft / np.maximum(whole, 1))
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability that each text is toxic."""
        parts = [np.zeros(0)]
        for _, _, buf, offsets in slices(column):
            z = self.text_features(buf, offsets) @ self.text[:-1] + self.text[-1]
            parts.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(parts)


def svm(x: np.ndarray, up: np.ndarray, down: np.ndarray, ridge: float = 1e-6, steps: int = 20) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss by Newton steps; each row counts ``up`` as toxic and ``down`` as clean."""
    w = np.zeros(x.shape[1] + 1)
    eye = ridge * np.eye(len(w))
    eye[-1, -1] = 1e-9

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float(up @ np.maximum(0, 1 - z) ** 2 + down @ np.maximum(0, 1 + z) ** 2 + w @ eye @ w)

    z = np.zeros(len(x))
    now = loss(z, w)
    for _ in range(steps):
        a, b = up * (z < 1), down * (z > -1)
        grad, hess = eye @ w, eye.copy()
        for lo in range(0, len(x), 1 << 14):
            part = lo + np.flatnonzero((a + b)[lo : lo + (1 << 14)])  # rows within their margin add nothing
            xb = np.concatenate([x[part].astype(np.float32), np.ones((len(part), 1), np.float32)], axis=1)
            grad += xb.T @ (a[part] * (z[part] - 1) + b[part] * (z[part] + 1))
            hess += (xb * (a + b)[part, None].astype(np.float32)).T @ xb
        step, share = np.linalg.solve(hess, grad), 1.0
        while True:
            new = w - share * step
            z2 = np.concatenate([x[lo : lo + (1 << 14)].astype(np.float32) @ new[:-1].astype(np.float32) for lo in range(0, len(x), 1 << 14)]) + new[-1]
            then = loss(z2, new)
            if then <= now or share < 1e-3:
                break
            share /= 2
        done = now - then < 1e-4 * now
        w, z, now = new, z2, then
        if done:
            break
    return w[:-1].astype(np.float32), float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps with a small ridge; the bias is the last weight."""
    xb = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(xb.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(xb @ w, -30, 30)))
        step = np.linalg.solve((xb * (p * (1 - p))[:, None]).T @ xb + 0.1 * np.eye(len(w)), xb.T @ (p - y) + 0.1 * w)
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    return w


def constant(score: float) -> Model:
    none = np.zeros((0, SIGNS), np.uint8)
    return Model(Landmarks(none), np.zeros(0, np.float32), -1.0, Parts(none), np.array([0, 0, 0, 0, 0, float(np.log(score / (1 - score)))]))


class Bags:
    """Distinct units of the texts that train, and which texts hold each."""

    def __init__(self):
        self.known, self.rows = spans.SpanTable(), np.zeros((0, SIGNS), np.uint8)
        self.pairs: list[np.ndarray] = []

    def add(self, p: Plain, start: np.ndarray, end: np.ndarray, row: np.ndarray, base: int) -> None:
        slot, new = self.known.numbers(p.buf, start, end, p.keys(start, end))
        self.rows = np.concatenate([self.rows, p.rows(start[new], end[new])])
        self.pairs.append(np.unique(((row + base) << 32) | slot))

    def held(self) -> tuple[np.ndarray, np.ndarray]:
        """Texts and units, each pair once."""
        pair = np.unique(np.concatenate(self.pairs))
        return pair >> 32, pair & 0xFFFFFFFF


def _drawn(weight: np.ndarray, chance: np.ndarray, n: int) -> np.ndarray:
    """``n`` places, drawn without putting back in proportion to ``weight``; ``chance`` is uniform in (0, 1)."""
    some = np.flatnonzero(weight > 0)
    if len(some) <= n:
        return some
    return some[np.argsort(-np.log(chance[some]) / weight[some], kind="stable")[:n]]


def spoilt(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units that leave room for it with a foreign letter or digit put in, at ``VIRTUAL`` places each; and whose they are."""
    rng = np.random.default_rng(3)
    who = np.repeat(np.flatnonzero(rows[:, -1] == 0), VIRTUAL)
    size = (rows[who] > 0).sum(axis=1)
    at = 1 + (rng.random(len(who)) * np.maximum(1, size - 1)).astype(np.int64)
    place = np.arange(SIGNS)
    moved = np.take_along_axis(rows[who], np.where(place < at[:, None], place, place - 1).clip(0), axis=1)
    moved[np.arange(len(who)), at] = rng.choice(np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyz", np.uint8), len(who))
    return moved, who


def fit(column: pa.Array, label: np.ndarray) -> Model:
    """Train on labelled texts, a part of which (every fifth) only calibrates.

    At first a unit counts as toxic by the share of toxic texts that hold it, and as clean
    by that of clean ones. In later rounds what a toxic text holds counts as toxic only where
    the machine says so, and its strongest unit always. Landmarks are drawn from the units of both
    classes by their squared excess in one of them, and of clean ones by how wrong the machine is
    there. The last round also learns from joined words, and from spoilt forms of what it takes for toxic.
    """
    apart = np.arange(len(label)) % 5 == 0
    if len(set(label[~apart].tolist())) < 2:
        apart[:] = False
    if len(set(label.tolist())) < 2:
        return constant(float(np.clip(label.mean(), 0.01, 0.99)) if len(label) else 0.01)
    bags = Bags()

    def read(model: Model | None) -> None:
        base = 0
        for _, _, buf, offsets in slices(column):
            p = Plain(buf, offsets)
            if model:
                first, last = model.joinable(p)
                start, end, row = p.start[first], p.end[last], p.row[first]
            else:
                start, end, row = p.units()
            use = ~apart[base + row]
            bags.add(p, start[use], end[use], row[use], base)
            base += len(offsets) - 1

    read(None)
    total = [max(1, int((label[~apart] == y).sum())) for y in (0, 1)]
    model, value = None, None
    for turn in range(ROUNDS):
        if turn == ROUNDS - 1:
            read(model)
        text, unit = bags.held()
        toxic = label[text] == 1
        count = lambda who: np.bincount(unit[who], minlength=len(bags.rows))
        up, down = count(toxic) / total[1], count(~toxic) / total[0]
        excess = up - down
        wrong = np.maximum(0, -excess)
        if model:
            value = np.concatenate([value, model.margins(bags.rows[len(value) :])])
            best = np.full(len(label), -np.inf)
            np.maximum.at(best, text[toxic], value[unit[toxic]])
            said = toxic & ((value[unit] > SURE) | ((value[unit] >= best[text]) & (value[unit] > 0)))
            up, down = count(said) / total[1], down + count(toxic & ~said) / total[1]
            excess, wrong = np.minimum(excess, up - down), down * np.maximum(0, value + 1)
        chance = (spans.mix(np.arange(1, len(excess) + 1, dtype=U)) >> U(11)).astype(np.float64) / (1 << 53) + 1e-17
        picked = _drawn(np.maximum(0, excess) ** 2, chance, LANDMARKS // 2)
        picked = np.union1d(picked, _drawn(np.maximum(0, -excess) ** 2, chance, LANDMARKS // 4))
        wrong[picked] = 0
        picked = np.union1d(picked, _drawn(wrong**2, chance, LANDMARKS - len(picked)))
        marks = Landmarks(bags.rows[picked])
        root, vector = np.linalg.eigh(marks.kernel(marks.rows).astype(np.float64) + 1e-4 * np.eye(len(marks.rows)))
        project = (vector / np.sqrt(np.maximum(root, 1e-4))).astype(np.float32)
        x = np.empty((len(bags.rows), len(marks.rows)), np.float16)
        for lo in range(0, len(x), BLOCK):
            x[lo : lo + BLOCK] = marks.kernel(bags.rows[lo : lo + BLOCK]) @ project
        if turn == ROUNDS - 1:
            sure = np.flatnonzero((value > SURE) & (up > down))
            virtual, whose = spoilt(bags.rows[sure])
            more = (marks.kernel(virtual) @ project).astype(np.float16)
            weights, bias = svm(np.concatenate([x, more]), np.concatenate([up, up[sure][whose] / VIRTUAL]), np.concatenate([down, np.zeros(len(more))]))
        else:
            weights, bias = svm(x, up, down)
        value = (np.concatenate([x[lo : lo + BLOCK].astype(np.float32) @ weights for lo in range(0, len(x), BLOCK)]) + bias).astype(np.float32)
        hot = np.flatnonzero((value > 0) & (up > down)) if turn >= ROUNDS - 2 else np.zeros(0, np.int64)
        model = Model(marks, project @ weights, bias, Parts(bags.rows[hot[np.argsort(-up[hot], kind="stable")]]), np.zeros(6))
        del x
    x = np.concatenate([model.text_features(buf, offsets) for _, _, buf, offsets in slices(column)])
    use = apart if len(set(label[apart].tolist())) == 2 else ~apart
    model.text = logistic(x[use], label[use])
    return model


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows outside fold 2 of 4; with no rows or one class only, a constant."""
    rows = labelled(spark, docs, labels, "toxic", ROWS_PER_CLASS, FOLDS, HELD_OUT)
    y = rows.column("label").to_numpy().astype(float) if rows.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return constant(0.99 if len(y) and y[0] else 0.01)
    return fit(rows.column("text").combine_chunks(), y)


def classify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs``; null and empty texts get the score of no unit at all.

    Repeated rows give repeated results, an empty table an empty one; texts are scored whole,
    a megabyte or one longer text at a time. Other columns are ignored.
    """
    with_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    found = classify(spark, docs, train(spark, docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.coalesce(fold("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "score", "predicted")
