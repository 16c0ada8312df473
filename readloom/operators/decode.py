"""Structured decoding: Viterbi paths with and without run-length bounds, penalties and comparisons.

Paths are dynamic programs over score matrices. They run where the reads are, without a shuffle, on arrays of
reads x labels: one step moves all reads of a stretch on by one place. What follows (penalties, agreement) is relational.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.functions.seq import let
from readloom.functions.sizes import at_most


#: Reads whose paths are worked out side by side.
TOGETHER = 256


def viterbi_batch(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> list[list[int]]:
    """The best path of labels of each read (reads x places x labels, padded beyond each read's size).

    Of equal paths, that with the lower label at the latest place where they differ.
    """
    n, t, k = scores.shape
    best, back = scores[:, 0].copy(), np.zeros((t, n, k), np.int16)
    for i in range(1, t):
        through = best[:, :, None] + moves
        come = through.argmax(1)
        live = (sizes > i)[:, None]
        back[i] = come
        best = np.where(live, np.take_along_axis(through, come[:, None], 1)[:, 0] + scores[:, i], best)
    return _traced(best.argmax(1), back, sizes)


def _traced(state: np.ndarray, back: np.ndarray, sizes: np.ndarray) -> list[list[int]]:
    rows, path = np.arange(len(sizes)), np.empty((len(back), len(sizes)), np.int64)
    for i in range(len(back) - 1, -1, -1):
        path[i] = state
        if i:
            state = np.where(sizes > i, back[i, rows, state], state)
    return [path[:size, r].tolist() for r, size in enumerate(sizes.tolist())]


def bounded_viterbi_batch(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray, bounds: Mapping[int, tuple[int, int]]) -> list[list[int]]:
    """The best path of each read whose runs of each bounded label have a length within its bounds; without any, the free path.

    States are (label, length so far). A label without bounds has one state; a bounded one has as many as its
    upper bound, so the work follows the bounds and not the read's length squared. Into a label's first state leads
    the best of the other labels' states that may be left; of equal sums that of the lower label, then of the lesser length.
    """
    n, t, k = scores.shape
    count = np.array([max(min(bounds[j][1], t), 1) if j in bounds else 1 for j in range(k)])
    start = np.concatenate([[0], np.cumsum(count)[:-1]])
    label = np.repeat(np.arange(k), count)
    length = np.arange(len(label)) - start[label] + 1
    low = np.array([bounds[j][0] if j in bounds else 1 for j in range(k)])[label]
    free = np.array([j not in bounds for j in range(k)])[label]
    open_ = np.array([j not in bounds or bounds[j][1] >= 1 for j in range(k)])
    may_leave, stay, s = length >= low, free | (length > 1), len(label)
    grow = np.where(free, np.arange(s), np.arange(s) - 1)  # the state with one less of the same label
    best = np.where((length == 1) & open_[label], scores[:, 0][:, label], -np.inf)
    back = np.zeros((t, n, s), np.int16 if s < 1 << 15 else np.int32)
    across = moves + np.where(np.eye(k, dtype=bool), -np.inf, 0.0)
    own = moves[label, label]
    rows, firsts = np.arange(n)[:, None], start[open_]
    far = np.abs(moves[np.isfinite(moves)]).max(initial=0.0)
    for i in range(1, t):
        out = np.where(may_leave, best, -np.inf)
        top = np.stack([out[:, a : a + c].argmax(1) + a for a, c in zip(start, count)], 1)  # reads x labels
        best_of = out[rows, top]
        through = best_of[:, :, None] + across
        from_ = through.argmax(1)  # of each label that is entered, the label that is left
        enter = np.take_along_axis(through, from_[:, None], 1)[:, 0]
        left = top[rows, from_]
        # a sum may be as great from a state of less length whose own score is lower in its last bits only
        with np.errstate(invalid="ignore"):  # a label that can't be left has no such state
            least = best_of - 4 * np.spacing(np.abs(best_of) + far)
        some = np.flatnonzero(((out >= least[:, label]) & (np.arange(s) < top[:, label])).any(1))
        if len(some):
            at = start[from_[some]][:, :, None] + np.minimum(np.arange(count.max()), count[from_[some]][:, :, None] - 1)
            sums = out[some[:, None, None], at] + across[from_[some], np.arange(k)][:, :, None]
            first = (sums == enter[some][:, :, None]).argmax(2)
            left[some] = np.take_along_axis(at, first[:, :, None], 2)[:, :, 0]
        new, come = np.where(stay, best[:, grow] + own, -np.inf), np.broadcast_to(grow, (n, s)).copy()
        better = enter[:, open_] > new[:, firsts]
        new[:, firsts] = np.where(better, enter[:, open_], new[:, firsts])
        come[:, firsts] = np.where(better, left[:, open_], come[:, firsts])
        back[i] = come
        best = np.where((sizes > i)[:, None], new + scores[:, i][:, label], best)
    end = np.where(may_leave, best, -np.inf)
    found = np.isfinite(end.max(1))
    paths = [label[p].tolist() for p in _traced(end.argmax(1), back, sizes)]
    lost = np.flatnonzero(~found)
    for r, path in zip(lost.tolist(), viterbi_batch(scores[lost], sizes[lost], moves) if len(lost) else []):
        paths[r] = path
    return paths


def viterbi(scores: np.ndarray, moves: np.ndarray) -> list[int]:
    """One read's best path."""
    return viterbi_batch(scores[None], np.array([len(scores)]), moves)[0]


def bounded_viterbi(scores: np.ndarray, moves: np.ndarray, bounds: Mapping[int, tuple[int, int]]) -> list[int]:
    """One read's best path within bounds."""
    return bounded_viterbi_batch(scores[None], np.array([len(scores)]), moves, bounds)[0]


def decode(
    rows: DataFrame,
    transitions: list[list[float]],
    bounds: Mapping[int, tuple[int, int]] | None = None,
    strategy: str = "viterbi",
    scores: str = "scores",
    out: str = "path",
) -> DataFrame:
    """``rows`` and an array of labels decoded from ``scores`` (array<array<double>>, log scores of each place).

    strategy: ``argmax`` (each place by itself), ``viterbi``, or ``constrained`` by ``bounds``. Null or empty
    scores give an empty path.
    """
    if strategy not in ("argmax", "viterbi", "constrained"):
        raise ValueError(f"no such strategy: {strategy}")
    rows = rows.drop(out)
    moves, at = np.array(transitions, float), rows.columns.index(scores)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    k = len(moves)

    def paths_of(column: pa.ListArray) -> list[list[int]]:
        sizes = np.nan_to_num(pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
        column = column.fill_null([]) if column.null_count else column
        flat = np.asarray(column.flatten().flatten().to_numpy(zero_copy_only=False), float)
        if len(flat) != sizes.sum() * k:
            raise ValueError(f"each place needs {k} scores")
        flat, starts = flat.reshape(-1, k), np.concatenate([[0], np.cumsum(sizes)])
        if strategy == "argmax":
            every = flat.argmax(1)
            return [every[a:b].tolist() for a, b in zip(starts, starts[1:])]
        found: list[list[int]] = [[] for _ in sizes]
        order = np.argsort(sizes, kind="stable")  # reads of like length together, so that little is padded
        order = order[sizes[order] > 0]
        for at in range(0, len(order), TOGETHER):
            some = order[at : at + TOGETHER]
            block = np.zeros((len(some), int(sizes[some].max()), k))
            for i, r in enumerate(some.tolist()):
                block[i, : sizes[r]] = flat[starts[r] : starts[r + 1]]
            if strategy == "constrained":
                paths = bounded_viterbi_batch(block, sizes[some], moves, bounds or {})
            else:
                paths = viterbi_batch(block, sizes[some], moves)
            for r, path in zip(some.tolist(), paths):
                found[r] = path
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cut in range(0, batch.num_rows, 4 * TOGETHER):
                part = batch.slice(cut, 4 * TOGETHER)
                paths = pa.array(paths_of(part.column(at)), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, paths], [*part.schema.names, out])

    return rows.mapInArrow(run, f"{fields}, `{out}` array<int>")


def length_penalty(runs: DataFrame, bounds: DataFrame, weight: float = 1.0, normalize: bool = False) -> DataFrame:
    """(read_id, penalty): squared shortfalls and excesses of run lengths, summed; optionally over the number of runs."""
    n = F.col("n")
    miss = F.pow(F.greatest(F.lit(0), F.col("min_len") - n), F.lit(2)) + F.pow(F.greatest(F.lit(0), n - F.col("max_len")), F.lit(2))
    joined = runs.join(F.broadcast(at_most(bounds, 10_000, "bounded labels")), "label", "left")
    total = F.sum(F.coalesce(miss, F.lit(0.0)))
    if normalize:
        total = F.coalesce(F.try_divide(total, F.count("min_len")), F.lit(0.0))
    return joined.groupBy("read_id").agg((total * weight).alias("penalty"))


def length_violations(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """Runs (with their length n) of bounded labels that are shorter or longer than allowed; bounds that contradict themselves are refused."""
    if not at_most(bounds, 10_000, "bounded labels").filter("min_len > max_len OR min_len < 0").isEmpty():
        raise ValueError("a least length above the greatest one")
    found = runs.join(F.broadcast(bounds), "label").withColumn("short", F.col("n") < F.col("min_len")).withColumn("long", F.col("n") > F.col("max_len"))
    return found.filter("short OR long")


def agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(share of equal places, number of differing places) of two label arrays of one length."""
    same = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 1).otherwise(0))
    hits = F.aggregate(same, F.lit(0), lambda s, x: s + x)
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(same)), F.lit(1.0)), F.size(same) - hits


def path_score(scores: Column, path: Column, transitions: list[list[float]]) -> Column:
    """The sum of a path's own scores and of its moves from label to label; an empty path has 0."""
    moves = F.array(*[F.array(*[F.lit(float(x)) for x in row]) for row in transitions])
    own = F.zip_with(scores, path, lambda s, j: F.get(s, j))
    before = F.slice(path, F.lit(1), F.greatest(F.size(path) - 1, F.lit(0)))
    after = F.slice(path, F.lit(2), F.greatest(F.size(path) - 1, F.lit(0)))
    steps = F.zip_with(before, after, lambda a, b: F.get(F.get(moves, a), b))
    return F.aggregate(F.concat(own, steps), F.lit(0.0), lambda a, x: a + x)


def log_partition(scores: Column, transitions: list[list[float]]) -> Column:
    """log of the summed exponentials of all paths' scores: the forward algorithm as a fold over a read's places."""
    into = F.array(*[F.array(*[F.lit(float(row[b])) for row in transitions]) for b in range(len(transitions))])

    def log_sum(x: Column) -> Column:
        high = F.array_max(x)
        return high + F.log(F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - high)))

    def step(alpha: Column, row: Column) -> Column:
        return F.transform(row, lambda s, b: s + let(F.zip_with(alpha, F.get(into, b), lambda x, m: x + m), log_sum))

    return let(F.aggregate(F.slice(scores, F.lit(2), F.size(scores)), F.get(scores, F.lit(0)), step), log_sum)


def log_likelihood(scores: np.ndarray, moves: np.ndarray, path: list[int]) -> float:
    """log p(path) of a linear-chain model: the path's score less the log partition (forward algorithm)."""
    alpha = scores[0].astype(float)
    for row in scores[1:]:
        x = alpha[:, None] + moves
        top = x.max(0)
        alpha = top + np.log(np.exp(x - top).sum(0)) + row
    norm = alpha.max() + np.log(np.exp(alpha - alpha.max()).sum())
    total = sum(scores[i, j] for i, j in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))
    return float(total - norm)
