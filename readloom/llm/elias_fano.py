"""Elias-Fano sequences and the n-gram trie made of them, searched a whole array at a time."""

from __future__ import annotations

import mmap

import numpy as np

_ZEROS, _ONES = np.zeros((256, 8), np.uint8), np.zeros((256, 8), np.uint8)  # place of the k-th zero or one bit of a byte
for _b in range(256):
    for _table, _bit in ((_ZEROS, 0), (_ONES, 1)):
        _places = [i for i in range(8) if _b >> i & 1 == _bit]
        _table[_b, : len(_places)] = _places


class EliasFano:
    """A non-decreasing sequence: low bits as whole bytes, high bits in unary, and a zero directory."""

    def __init__(self, low: np.ndarray, high: np.ndarray, zeros: np.ndarray, shift: int):
        self.low, self.high, self.zeros, self.shift = low, high, zeros, shift

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        """``values``: sorted, not negative, below 2**63."""
        n = len(values)
        top = int(values[-1]) if n else 0
        shift = next(s for s in (0, 8, 16, 32, 48) if top >> s <= max(8 * n, 64) or s == 48)
        low = (values & ((1 << shift) - 1)).astype({0: "u1", 8: "u1", 16: "u2", 32: "u4", 48: "u8"}[shift])
        at = (values >> shift) + np.arange(n)
        bits = np.zeros(-(-((top >> shift) + n + 2) // 64) * 8, np.uint8)
        np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        zeros = np.concatenate([[0], np.cumsum(8 - np.bitwise_count(bits).astype(np.int64))])
        return cls(low, bits, zeros[::8].copy(), shift)

    def _before(self, bucket: np.ndarray) -> np.ndarray:
        """How many elements have high bits below ``bucket``: the place of zero number bucket - 1, less the zeros."""
        k = np.maximum(bucket - 1, 0)
        k = np.minimum(k, self.zeros[-1] - 1)
        word = np.searchsorted(self.zeros, k, "right") - 1
        left, at = k - self.zeros[word], word * 8
        for _ in range(7):
            here = 8 - np.bitwise_count(self.high[at]).astype(np.int64)
            step = left >= here
            left, at = left - step * here, at + step
        return np.where(bucket > 0, at * 8 + _ZEROS[self.high[at], left] - k, 0)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The elements number i."""
        ones = 64 * np.arange(len(self.zeros)) - self.zeros  # before each 64 bits; the last entry may count too many
        word = np.minimum(np.searchsorted(ones, i, "right"), len(ones)) - 1
        left, at = i - ones[word], word * 8
        for _ in range(7):
            here = np.bitwise_count(self.high[np.minimum(at, len(self.high) - 1)]).astype(np.int64)
            step = left >= here
            left, at = left - step * here, at + step
        bucket = at * 8 + _ONES[self.high[at], left] - i
        return (bucket << self.shift) + self.low[i].astype(np.int64)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first element that isn't below x (the length if all are)."""
        n = len(self.low)
        bucket = x >> self.shift
        a = np.minimum(self._before(bucket), n)
        b = np.minimum(self._before(bucket + 1), n)
        want = x & ((1 << self.shift) - 1)
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            less = open_ & (self.low[np.minimum(mid, n - 1)] < want)
            a, b = np.where(less, mid + 1, a), np.where(open_ & ~less, mid, b)
        return a

    def find(self, x: np.ndarray) -> np.ndarray:
        """The index of x, or -1."""
        n = len(self.low)
        if not n:
            return np.full(len(x), -1)
        at = self.successor(x)
        # the element at ``at`` is x if its low bits agree and it lies in x's bucket
        same = (at < self._before((x >> self.shift) + 1)) & (at < n)
        same &= self.low[np.minimum(at, n - 1)] == (x & ((1 << self.shift) - 1))
        return np.where(same, at, -1)

    def parts(self) -> list[np.ndarray]:
        return [self.low, self.high, self.zeros]


def _quantised(values: np.ndarray, levels: int) -> tuple[np.ndarray, float, float]:
    least = float(values.min()) if len(values) else 0.0
    step = ((float(values.max()) - least) / levels or 1.0) if len(values) else 1.0
    return np.rint((values - least) / step).astype(np.uint16), least, step


class Trie:
    """Words, below each the words before it, and below each of these the words before both, with a value for each n-gram.

    Words and contexts are Elias-Fano sequences of their numbers. The entries below a node are a range of
    the next level, found by that level's pointers, a monotone sequence of range starts. Within a range an
    entry is its context's place among all contexts, counted on from the last entry of the range before; so a
    level is one monotone sequence, and a context is found by successor search relative to where its
    range begins. Values are quantised to 16 bits. All of it lies in one memory map, which is written to and
    opened from plain bytes, so that a trie can be stored and searched by tasks that didn't build it.
    """

    LEVELS = 65_535
    SEQUENCES = ("words", "contexts", "pointers2", "level2", "pointers3", "level3")

    def __init__(self, stored: bytes):
        self.map = mmap.mmap(-1, len(stored))
        self.map[:] = stored
        (head,) = np.frombuffer(self.map, np.int64, 1)
        info = np.frombuffer(self.map, np.int64, int(head), 8)
        self.scale = np.frombuffer(self.map, np.float64, 6, 8 + 8 * int(head))
        at, arrays = 8 + 8 * int(head) + 48, []
        for kind, size in info[6:].reshape(-1, 2).tolist():
            dtype = np.dtype({1: "u1", 2: "u2", 4: "u4", 8: "u8", -8: "i8"}[kind])
            arrays.append(np.frombuffer(self.map, dtype, size, at))
            at += -(-size * dtype.itemsize // 8) * 8
        for i, name in enumerate(self.SEQUENCES):
            setattr(self, name, EliasFano(*arrays[3 * i : 3 * i + 3], int(info[i])))
        self.counts, self.codes2, self.after2, self.codes3 = arrays[18:]

    @classmethod
    def build(cls, words, counts, contexts, parent2, context2, parent3, context3, value2, after2, value3) -> bytes:
        """The bytes of a trie.

        words, contexts: sorted distinct numbers; counts: of the words. An entry of level 2 (3) is given by its
        parent's place in words (in level 2) and its context's place in contexts, sorted by both.
        """
        sequences = [words, contexts]
        for parents, parent, context in ((len(words), parent2, context2), (len(parent2), parent3, context3)):
            starts = np.searchsorted(parent, np.arange(parents + 1))
            # the last entry of each range, added up, is where the next range counts on from
            sizes = np.diff(starts)
            lasts = np.zeros(parents, np.int64)
            full = sizes > 0
            lasts[full] = context[starts[1:][full] - 1] + 1
            base = np.cumsum(lasts) - lasts
            sequences += [starts, base[parent] + context + 1 if len(parent) else np.empty(0, np.int64)]
        built = [EliasFano.build(np.asarray(x, np.int64)) for x in sequences]
        coded = [_quantised(v, cls.LEVELS) for v in (value2, after2, value3)]
        arrays = [part for e in built for part in e.parts()] + [np.asarray(counts, np.int64), *(c[0] for c in coded)]
        info = np.array([*(e.shift for e in built), *(x for a in arrays for x in (-8 if a.dtype == np.int64 else a.dtype.itemsize, len(a)))], np.int64)
        scale = np.array([x for c in coded for x in c[1:]])
        padded = [a.tobytes() + bytes(-a.nbytes % 8) for a in arrays]
        return b"".join([np.array([len(info)]).tobytes(), info.tobytes(), scale.tobytes(), *padded])

    def child(self, level: int, parent: np.ndarray, context: np.ndarray) -> np.ndarray:
        """The place in ``level`` of a context (its place among all) below a parent; -1 if either is -1 or it isn't there."""
        pointers, entries = (self.pointers2, self.level2) if level == 2 else (self.pointers3, self.level3)
        out = np.full(len(parent), -1)
        known = np.flatnonzero((parent >= 0) & (context >= 0))
        if not len(known) or not len(entries.low):
            return out
        a, b = pointers.get(parent[known]), pointers.get(parent[known] + 1)
        base = np.where(a > 0, entries.get(np.maximum(a - 1, 0)), 0)
        at = entries.find(base + context[known] + 1)
        out[known] = np.where((at >= a) & (at < b), at, -1)
        return out

    def value2(self, i: np.ndarray) -> np.ndarray:
        return self.scale[0] + self.scale[1] * self.codes2[i]

    def after(self, i: np.ndarray) -> np.ndarray:
        return self.scale[2] + self.scale[3] * self.after2[i]

    def value3(self, i: np.ndarray) -> np.ndarray:
        return self.scale[4] + self.scale[5] * self.codes3[i]
