"""Periodic run detection (operator 11): repeated stretches of words by partition refinement.

A run is a maximal stretch of words that repeats with some smallest period. Positions of a text are kept in classes
of equal factors of length k, k = 1, 2, ...; classes are refined from one length to the next by the smaller halves of
those that were split, so a position moves O(log n) times (Crochemore's method):

1. Positions i and j belong together at k + 1 if they do at k and i + 1, j + 1 do, too. So only positions before
   members of a class that has just come to be can leave their class, and of the parts of a split class the
   largest needn't be looked at.
2. Members of a class are linked in order. Where a member's next one is exactly k words on, a square of period k
   starts; its root is primitive, as otherwise the next member were nearer. Gaps are noted when a link is made and
   looked up when k reaches them.
3. Squares of one period that start at neighbouring words belong to one run.

A run of exponent e has a period of at most a text's length / e, so a text leaves the refinement at that length.
Many texts are refined at once, as arrays: a row's text is whole in one task, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from readloom.llm.common import as_bytes, slices

#: A run has so many words and so many periods, at least.
LEAST_LENGTH, LEAST_EXPONENT = 6, 4
#: Bytes of text that are refined at once, about; a longer text is taken alone (some 25 bytes a byte of text).
BATCH = 12 << 20
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges [start, start + size), one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


def _edges(x: np.ndarray) -> np.ndarray:
    """Where stretches of equal values start."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


class Refinement:
    """Positions in classes of equal factors, which ``refine`` makes one word longer.

    ``words``: numbers of the words; each text is followed by a number of its own. ``most``: the longest period
    looked for at each position. A class is a stretch of ``order``; next and previous members are linked.
    """

    def __init__(self, words: np.ndarray, most: np.ndarray, texts: np.ndarray):
        n = len(words)
        self.n, self.k, self.most = n, 1, most
        keys = texts.astype(np.int64) * (int(words.max()) + 1 if n else 1) + words
        self.order = np.argsort(keys, kind="stable")
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        first = _edges(keys[self.order])
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.classes = len(first)
        self.start[: len(first)], self.size[: len(first)] = first, np.diff(first, append=n)
        self.of = np.empty(n, np.int64)
        self.of[self.order] = np.repeat(np.arange(len(first)), self.size[: len(first)])
        self.next, self.previous = np.full(n, -1), np.full(n, -1)
        self.marked = np.zeros(n, bool)
        self.gaps: dict[int, list[np.ndarray]] = {}
        self._link(self.order, keys[self.order])
        self.fresh = np.arange(n)  # members of classes that have just come to be

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Links positions, in the order of their groups and within them of the text."""
        same = group[1:] == group[:-1]
        self.next[members], self.previous[members] = -1, -1
        left, right = members[:-1][same], members[1:][same]
        self.next[left], self.previous[right] = right, left
        self._note(left, right)

    def _note(self, left: np.ndarray, right: np.ndarray) -> None:
        gap = right - left
        fits = (gap >= self.k) & (gap <= self.most[left])
        left, gap = left[fits], gap[fits]
        if not len(left):
            return
        order = np.argsort(gap, kind="stable")
        left, gap = left[order], gap[order]
        first = _edges(gap)
        for g, part in zip(gap[first].tolist(), np.split(left, first[1:])):
            self.gaps.setdefault(g, []).append(part)

    def squares(self) -> np.ndarray:
        """Positions where a square of period k starts whose root has no shorter period."""
        parts = self.gaps.pop(self.k, None)
        if not parts:
            return np.empty(0, np.int64)
        at = np.unique(np.concatenate(parts))
        return at[self.next[at] == at + self.k]

    def refine(self) -> None:
        """From factors of k words to those of k + 1."""
        self.k += 1
        before = self.fresh[self.fresh > 0] - 1
        cls = self.of[before]
        wanted = (self.size[cls] > 1) & (self.most[before] >= self.k)
        before, cls = before[wanted], cls[wanted]
        self.fresh = np.empty(0, np.int64)
        if not len(before):
            return
        after = self.of[before + 1]
        order = np.argsort(cls * self.n + after, kind="stable")
        before, cls, after = before[order], cls[order], after[order]
        # groups: parts of a class by the class of the next position
        g = np.flatnonzero(np.concatenate([[True], (cls[1:] != cls[:-1]) | (after[1:] != after[:-1])]))
        g_size, g_class = np.diff(g, append=len(cls)), cls[g]
        c = _edges(g_class)
        most = np.maximum.reduceat(g_size, c)
        rest = self.size[g_class[c]] - np.add.reduceat(g_size, c)
        counts = np.diff(c, append=len(g_class))
        # the first largest group of each class
        at = np.where(g_size == np.repeat(most, counts), np.arange(len(g_size)), len(g_size))
        largest = np.minimum.reduceat(at, c)
        # a class that is moved as a whole keeps its largest group; the others leave
        whole = rest == 0
        stays = np.zeros(len(g), bool)
        stays[largest[whole]] = True
        small = np.ones(len(g), bool)
        small[largest[whole | (most > rest)]] = False
        rest_is_small = ~whole & (most > rest)
        remaining = g_class[c][rest_is_small]
        if stays.any():
            keep = np.repeat(~stays, g_size)
            before, cls = before[keep], cls[keep]
            g_size, g_class, small = g_size[~stays], g_class[~stays], small[~stays]
        if not len(before):
            return
        self._move(before, cls, g_size, g_class)
        parts = [before[np.repeat(small, g_size)]]
        if len(remaining):
            parts.append(self.order[_ranges(self.start[remaining], self.size[remaining])])
        self.fresh = np.sort(np.concatenate(parts))

    def _move(self, moved: np.ndarray, cls: np.ndarray, g_size: np.ndarray, g_class: np.ndarray) -> None:
        """Makes groups of positions, sorted by class, group and place, classes of their own."""
        # what is left of a class is linked over stretches of moved members
        order = np.argsort(cls * self.n + moved)
        m, mc = moved[order], cls[order]
        follows = np.concatenate([[False], (mc[1:] == mc[:-1]) & (self.next[m[:-1]] == m[1:])])
        first = np.flatnonzero(~follows)
        left, right = self.previous[m[first]], self.next[m[np.append(first[1:], len(m)) - 1]]
        self.next[left[left >= 0]] = right[left >= 0]
        self.previous[right[right >= 0]] = left[right >= 0]
        both = (left >= 0) & (right >= 0)
        self._note(left[both], right[both])
        self._link(moved, np.repeat(np.arange(len(g_size)), g_size))
        # moved members take the end of their class's stretch, those that stay there take the places left free
        c = _edges(cls)
        n_moved = np.diff(c, append=len(cls))
        tail = self.start[cls[c]] + self.size[cls[c]] - n_moved
        slots = _ranges(tail, n_moved)
        self.marked[moved] = True
        there = self.order[slots]
        there = there[~self.marked[there]]
        self.marked[moved] = False
        holes = self.place[moved]
        holes = holes[holes < np.repeat(tail, n_moved)]
        self.order[holes], self.place[there] = there, holes
        self.order[slots], self.place[moved] = moved, slots
        self.size[cls[c]] -= n_moved
        new = self.classes + np.arange(len(g_size))
        self.classes += len(g_size)
        self.start[new], self.size[new] = slots[np.cumsum(g_size) - g_size], g_size
        self.of[moved] = np.repeat(new, g_size)


def find_runs(words: np.ndarray, sizes: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """Rows (first position, length, period) of all runs, by position and period.

    ``words``: numbers of the words of all texts, each text followed by a number that occurs once; ``sizes``: its
    numbers, this one included.
    """
    if not len(words):
        return np.empty((0, 3), np.int64)
    most = np.repeat((sizes - 1) // least_exponent, sizes)
    state = Refinement(words, most, np.repeat(np.arange(len(sizes)), sizes))
    found = []
    while True:
        at = state.squares()
        if len(at):
            first = np.flatnonzero(np.concatenate([[True], np.diff(at) > 1]))
            length = np.diff(first, append=len(at)) - 1 + 2 * state.k
            long = length >= max(least_length, least_exponent * state.k)
            found.append(np.stack([at[first][long], length[long], np.full(int(long.sum()), state.k)], 1))
        if not len(state.fresh):
            break
        state.refine()
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def runs_of(texts: list[bytes | None], least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> tuple[list[np.ndarray], list[bytes]]:
    """Of each text its runs (start, length, period), counted in words, and its words without the repeats, joined by a space."""
    split = [(t or b"").split() for t in texts]
    known = {w: i for i, w in enumerate(set().union(*split))}
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    number = known.__getitem__
    ends = iter(range(len(known), len(known) + len(split)))
    words = np.fromiter((x for part in split for x in (*map(number, part), next(ends))), np.int64, int(sizes.sum()))
    runs = find_runs(words, sizes, least_length, least_exponent)
    firsts = np.cumsum(sizes) - sizes
    own = np.searchsorted(firsts, runs[:, 0], side="right") - 1
    runs[:, 0] -= firsts[own]
    edges = np.searchsorted(own, np.arange(len(split) + 1))
    listed = [runs[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    return listed, [b" ".join(_without(part, r)) for part, r in zip(split, listed)]


def _without(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    if not len(runs):
        return words
    dropped = np.zeros(len(words) + 1, np.int64)
    np.add.at(dropped, runs[:, 0] + runs[:, 2], 1)
    np.add.at(dropped, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(dropped[:-1]) == 0).tolist()]


def with_runs(
    docs: DataFrame,
    text_col: str = "text",
    least_length: int = LEAST_LENGTH,
    least_exponent: int = LEAST_EXPONENT,
    runs_col: str = "runs",
    collapsed_col: str = "collapsed",
    batch: int = BATCH,
) -> DataFrame:
    """``docs`` and two columns: the text's runs and the text without its repeats. No shuffle.

    Words are stretches of anything but ASCII white space, as they are written. A run is a longest stretch of words
    with a smallest period q (words q apart are equal) and a length of at least ``least_length`` words and
    ``least_exponent`` (2 or more) periods; runs are structs (start, length, period), in words from 0, by start, then
    period. Words that some run holds after its first period go; those that are left are joined by one space. Null,
    empty and blank texts have no runs and the empty text is left. Rows keep their number and order; columns with these names give
    way; an empty table gives no rows. A task holds ``batch`` bytes of text at once, or one longer text.
    """
    if least_exponent < 2:
        raise ValueError("a run has two periods at least")
    docs = docs.drop(runs_col, collapsed_col)
    at = docs.columns.index(text_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, batch):
            runs, left = runs_of(as_bytes(part.column(at)), least_length, least_exponent)
            counts = np.cumsum([0, *map(len, runs)]).astype(np.int32)
            rows = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
            structs = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], fields=list(_RUN))
            columns = [*part.columns, pa.ListArray.from_arrays(pa.array(counts), structs), pa.array(left, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, runs_col, collapsed_col])

    return docs.mapInArrow(run, f"{fields}, `{runs_col}` array<struct<start:long,length:long,period:long>>, `{collapsed_col}` string")
