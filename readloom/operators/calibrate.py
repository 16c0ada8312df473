"""Fitting what calibrates and combines predictions: temperature, isotonic steps, logistic curves and stacking.

All fits are exact optimisers over sums: a pass over the data adds up derivatives (or pools neighbours) by task, the sums are
added up by Spark, and the driver, which holds a few numbers for each label or model, takes the next step. No pass
depends on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.scratch import kept
from readloom.functions.sizes import at_most

EPSILON = 1e-10
PLACE = ("read_id", "pos")
#: Blocks of all labels' isotonic steps that may be sent to every task (some 40 bytes each), and labels of one call.
MOST_BLOCKS, MOST_LABELS = 2_000_000, 100_000
#: Parameters of a stacked model: its second derivatives are a square of so many numbers.
MOST_PARAMETERS = 1_000


def _with_truth(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    return predictions.join(truth.select(*PLACE, F.col("label").alias("truth")), [*PLACE])


# --- temperature ------------------------------------------------------------------------------------


@dataclass
class Temperature:
    temperature: float
    nll: float  # mean over places
    gradient: float  # of the mean, by the inverse temperature
    passes: int


def fit_temperature(predictions: DataFrame, truth: DataFrame, low: float = 0.1, high: float = 10.0, tolerance: float = 1e-10, most: int = 60) -> Temperature:
    """The temperature within [low, high] under which the truth is most likely.

    In the inverse temperature the likelihood of softmax(log(p) / temperature) has one peak. Newton steps from sums of first and
    second derivatives go towards it; a step that leaves the bracket is halved into it, so the search can't miss. A peak
    outside of the bounds gives the bound. Places without a prediction for the true label don't count; without places the
    temperature is 1.
    """
    x = F.log(F.col("p") + EPSILON)
    cells = _with_truth(predictions, truth).groupBy(*PLACE)
    places = cells.agg(F.collect_list(x).alias("x"), F.max(F.when(F.col("label") == F.col("truth"), x)).alias("own"))
    places = places.filter("own is not null").select("x", "own", F.array_max("x").alias("top")).persist(StorageLevel.MEMORY_AND_DISK)
    passes = 0

    def sums(*inverse: float) -> list[tuple[float, float, float]]:
        """(mean nll, first, second derivative) at each inverse temperature, in one pass."""
        nonlocal passes
        passes += 1
        parts = []
        zero = F.struct(*[F.lit(0.0).alias(c) for c in ("s", "sx", "sxx")])

        def weighed(b: float):
            def add(a: Column, v: Column) -> Column:
                d = v - F.col("top")
                e = F.exp(b * d)
                return F.struct((a["s"] + e).alias("s"), (a["sx"] + e * d).alias("sx"), (a["sxx"] + e * d * d).alias("sxx"))

            return add

        for b in inverse:
            z = F.aggregate("x", zero, weighed(b))
            mean = z["sx"] / z["s"]
            gap = F.col("own") - F.col("top")
            parts += [F.avg(F.log(z["s"]) - b * gap), F.avg(mean - gap), F.avg(z["sxx"] / z["s"] - mean * mean)]
        row = places.agg(*[p.alias(f"c{i}") for i, p in enumerate(parts)]).first()
        return [tuple(0.0 if v is None else v for v in row[i : i + 3]) for i in range(0, len(parts), 3)]

    try:
        a, b, x0 = 1 / high, 1 / low, min(max(1.0, 1 / high), 1 / low)
        at_a, at_b, now = sums(a, b, x0)
        if not any((*at_a, *at_b, *now)):
            return Temperature(1.0, 0.0, 0.0, passes)
        if at_a[1] >= 0:
            return Temperature(1 / a, at_a[0], at_a[1], passes)
        if at_b[1] <= 0:
            return Temperature(1 / b, at_b[0], at_b[1], passes)
        while abs(now[1]) > tolerance and passes < most:
            a, b = (a, x0) if now[1] > 0 else (x0, b)
            step = x0 - now[1] / now[2] if now[2] > 0 else a
            x0 = step if a < step < b else (a + b) / 2
            now = sums(x0)[0]
        return Temperature(1 / x0, now[0], now[1], passes)
    finally:
        places.unpersist()


# --- isotonic steps ---------------------------------------------------------------------------------

_BLOCK = "label int, low double, high double, n long, hits long"


def pool(low: np.ndarray, high: np.ndarray, n: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order, neighbours pooled until their shares of hits rise."""
    kept: list[list] = []
    for a, b, m, h in zip(low.tolist(), high.tolist(), n.tolist(), hits.tolist()):
        while kept and kept[-1][3] * m >= h * kept[-1][2]:
            a, _, m0, h0 = kept.pop()
            m, h = m + m0, h + h0
        kept.append([a, b, m, h])
    columns = zip(*kept) if kept else ([], [], [], [])
    return tuple(np.array(c, k) for c, k in zip(columns, (float, float, np.int64, np.int64)))


def _joined(table: pa.Table) -> pa.Table:
    """Blocks of (label, low, ...) in order, pooled within each label."""
    label, *columns = (table.column(c).to_numpy() for c in ("label", "low", "high", "n", "hits"))
    first = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]])) if len(label) else np.empty(0, int)
    parts = [(label[a], pool(*(c[a:b] for c in columns))) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(label)])]
    labels = np.concatenate([np.full(len(p[0]), k) for k, p in parts]) if parts else np.empty(0)
    rest = [np.concatenate([p[i] for _, p in parts]) if parts else np.empty(0) for i in range(4)]
    kinds = (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip((labels, *rest), kinds)], names=[c.split()[0] for c in _BLOCK.split(", ")])


def isotonic_blocks(rows: DataFrame) -> DataFrame:
    """(label, low, high, n, hits) from (label, p, hit): for every label the steps of its non-decreasing fit of hit on p.

    Rows of equal label and p are counted where they are read, then all are dealt by ranges of (label, p) in one shuffle. A task
    pools the neighbours of its range; what it pools the whole would pool, too, so only blocks go on. Blocks of a label that are
    left have rising shares of whole numbers, of which n rows can't make more than n^(2/3).
    Rows with a null are left out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, p, hit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "p", "hit"))
            order = np.lexsort((p, label))
            low = pa.array(p[order])
            rows = [pa.array(label[order], pa.int32()), low, low, pa.array(np.ones(len(p), np.int64)), pa.array(hit[order].astype(np.int64))]
            yield from _same(pa.table(rows, ["label", "low", "high", "n", "hits"])).to_batches()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # blocks so far, few
        last: pa.Table | None = None  # the last place's counts: more of it may follow
        for batch in batches:
            table = pa.table(batch) if last is None else pa.concat_tables([last, pa.table(batch)])
            table = _same(table)
            last = table.slice(max(0, table.num_rows - 1))
            table = table.slice(0, max(0, table.num_rows - 1))
            held = _joined(table if held is None else pa.concat_tables([held, table]))
        if held is not None:
            yield from _joined(pa.concat_tables([held, last])).to_batches()

    def join(_: tuple, table: pa.Table) -> pa.Table:
        return _joined(table.sort_by([("low", "ascending")]))

    picked = rows.select(F.col("label").cast("int").alias("label"), F.col("p").cast("double").alias("p"), F.col("hit").cast("boolean").alias("hit"))
    counted = picked.dropna().mapInArrow(count, _BLOCK)
    ranged = counted.repartitionByRange("label", "low").sortWithinPartitions("label", "low")
    return ranged.mapInArrow(local, _BLOCK).groupBy("label").applyInArrow(join, _BLOCK)


def _same(table: pa.Table) -> pa.Table:
    """Sorted rows of equal label and place, added up."""
    label, low, high, n, hits = (table.column(c).to_numpy() for c in ("label", "low", "high", "n", "hits"))
    first = np.ones(len(label), bool)
    first[1:] = (label[1:] != label[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    at = np.flatnonzero(first)
    sums = [np.add.reduceat(x, at) if len(at) else x for x in (n, hits)]
    return pa.table({"label": pa.array(label[at], pa.int32()), "low": low[at], "high": high[at], "n": sums[0], "hits": sums[1]})


def _steps(blocks: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each label: places and values of its steps' corners. The blocks are computed once; too many are refused."""
    found = blocks.limit(MOST_BLOCKS + 1).toPandas().sort_values(["label", "low"])
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"more than {MOST_BLOCKS} isotonic blocks")
    value = (found["hits"] / found["n"]).to_numpy()
    steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for label, at in found.reset_index(drop=True).groupby("label").indices.items():
        steps[int(label)] = (found[["low", "high"]].to_numpy()[at].ravel(), np.repeat(value[at], 2))
    return steps


def _stepped(label: pa.Array, p: pa.Array, steps: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    label, p = label.to_numpy(zero_copy_only=False), p.to_numpy(zero_copy_only=False).copy()
    for k in np.unique(label):
        if k in steps:
            own = label == k
            p[own] = np.interp(p[own], *steps[k])
    return p


def with_isotonic(predictions: DataFrame, blocks: DataFrame) -> DataFrame:
    """``predictions`` with p by its label's steps: straight lines between blocks, the outer values beyond them; other labels keep theirs. No shuffle."""
    sent = predictions.sparkSession.sparkContext.broadcast(_steps(blocks))
    columns = predictions.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in predictions.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _stepped(batch.column("label"), batch.column("p"), sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(p) if c == "p" else batch.column(c) for c in columns], columns)

    return predictions.mapInArrow(run, fields)


def _isotonic_shares(places: DataFrame, blocks: DataFrame) -> DataFrame:
    """(read_id, pos, label, p) from places (read_id, pos, cells): p by the labels' steps, made to add up to 1 within each place. No shuffle."""
    sent = places.sparkSession.sparkContext.broadcast(_steps(blocks))
    given = places.select(*PLACE, F.col("cells.label").alias("label"), F.col("cells.p").alias("p"))
    kinds = [given.schema[c].dataType.simpleString() for c in PLACE]
    kind = given.schema["label"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, n = batch.column("label").flatten(), np.diff(batch.column("p").offsets.to_numpy())
            p = _stepped(label, batch.column("p").flatten(), sent.value)
            at = np.repeat(np.arange(batch.num_rows), n)
            total = np.bincount(at, p, batch.num_rows)[at]
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(total <= 0, 1 / n[at], p / total)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in PLACE), label, pa.array(p)], [*PLACE, "label", "p"])

    return given.mapInArrow(run, f"read_id {kinds[0]}, pos {kinds[1]}, label {kind}, p double")


# --- logistic curves --------------------------------------------------------------------------------


def fit_platt(rows: DataFrame, steps: int = 50, tolerance: float = 1e-10) -> dict[int, tuple[float, float]]:
    """(slope, intercept) for each label of (label, p, hit): the logistic curve of hit on the log-odds of p.

    Newton steps for all labels at once: a pass adds up five numbers a label. A step that makes a label less likely is halved;
    labels whose hits are all alike, or told apart by p, get the curve of the last step. Rows with a null are left out.
    """
    p = F.least(F.greatest(F.col("p").cast("double"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    data = rows.select(F.col("label").cast("int").alias("label"), F.log(p / (1 - p)).alias("x"), F.col("hit").cast("double").alias("y")).dropna()
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    spark = rows.sparkSession
    try:
        labels = sorted(r["label"] for r in at_most(data.select("label").distinct(), MOST_LABELS, "labels").collect())
        theta = {k: np.zeros(2) for k in labels}
        move = {k: np.zeros(2) for k in labels}
        best = dict.fromkeys(labels, np.inf)
        left = set(labels)
        for _ in range(steps):
            if not left:
                break
            tried = spark.createDataFrame([(k, *map(float, theta[k] + move[k])) for k in sorted(left)], "label int, a double, b double")
            z = F.col("a") * F.col("x") + F.col("b")
            q = 1 / (1 + F.exp(-z))
            nll = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
            r, w, x = q - F.col("y"), q * (1 - q), F.col("x")
            parts = {"nll": nll, "g0": r * x, "g1": r, "h00": w * x * x, "h01": w * x, "h11": w, "n": F.lit(1.0)}
            found = data.join(F.broadcast(tried), "label").groupBy("label").agg(*[F.sum(c).alias(name) for name, c in parts.items()])
            for s in found.collect():
                k = s["label"]
                if s["nll"] > best[k] + 1e-12 * abs(best[k]) and np.abs(move[k]).max() > 1e-12:
                    move[k] = move[k] / 2
                    continue
                theta[k], best[k] = theta[k] + move[k], s["nll"]
                g = np.array([s["g0"], s["g1"]])
                if np.abs(g).max() <= tolerance * s["n"]:
                    left.discard(k)
                h = np.array([[s["h00"], s["h01"]], [s["h01"], s["h11"]]]) + 1e-9 * s["n"] * np.eye(2)
                move[k] = -np.linalg.solve(h, g)
        return {k: (float(v[0]), float(v[1])) for k, v in theta.items()}
    finally:
        data.unpersist()


def with_platt(predictions: DataFrame, curves: dict[int, tuple[float, float]]) -> DataFrame:
    """``predictions`` with p by its label's curve; other labels keep theirs. One row a label is sent to every task."""
    spark = predictions.sparkSession
    table = spark.createDataFrame([(k, a, b) for k, (a, b) in sorted(curves.items())], "label int, _a double, _b double")
    p = F.least(F.greatest(F.col("p"), F.lit(EPSILON)), F.lit(1 - EPSILON))
    curve = 1 / (1 + F.exp(-(F.col("_a") * F.log(p / (1 - p)) + F.col("_b"))))
    joined = predictions.join(F.broadcast(table), "label", "left")
    return joined.withColumn("p", F.when(F.col("_a").isNull(), F.col("p")).otherwise(curve)).select(predictions.columns)


def calibrate_labels(predictions: DataFrame, truth: DataFrame, way: str = "isotonic") -> DataFrame:
    """Predictions (read_id, pos, label, p) calibrated by themselves one label against the rest, as ``calibrated`` does."""
    if way not in ("isotonic", "platt"):
        raise ValueError(f"no such calibration: {way}")
    return calibrated(predictions, truth, predictions, way)


def _isotonic(known: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions are brought together by place and written once; from there they are calibrated where they are read, and learnt from if they are the ``known`` ones."""
    cells = predictions.select(*PLACE, F.struct("label", F.col("p").cast("double").alias("p")).alias("cell")).groupBy(*PLACE).agg(F.collect_list("cell").alias("cells"))
    if known is not predictions:
        both = _with_truth(known, truth).select("label", "p", (F.col("label") == F.col("truth")).alias("hit"))
        return _isotonic_shares(kept(cells, "places"), isotonic_blocks(both))
    truths = truth.groupBy(*PLACE).agg(F.collect_list("label").alias("truths"))
    places = kept(cells.join(truths, [*PLACE], "left"), "places")
    both = places.select("cells", F.explode("truths").alias("truth")).select("truth", F.inline("cells"))
    return _isotonic_shares(places, isotonic_blocks(both.select("label", "p", (F.col("label") == F.col("truth")).alias("hit"))))


def calibrated(known: DataFrame, truth: DataFrame, predictions: DataFrame, way: str) -> DataFrame:
    """``predictions`` (read_id, pos, label, p) by what ``known`` ones and their truth teach: none, isotonic, platt or temperature.

    The first two calibrate one label against the rest, all labels at once, and then make p add up to 1 at each place; a place whose
    labels all come out as 0 gets equal shares.
    """
    if way not in ("none", "isotonic", "platt", "temperature"):
        raise ValueError(f"no such calibration: {way}")
    picked = predictions.select(*PLACE, "label", "p")
    if way == "none":
        return picked
    own = Window.partitionBy(*PLACE)
    if way == "temperature":
        inverse = 1 / fit_temperature(known, truth).temperature
        x = picked.withColumn("_x", F.log(F.col("p") + EPSILON) * inverse).withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(own)))
        return x.select(*PLACE, "label", (F.col("_e") / F.sum("_e").over(own)).alias("p"))
    if way == "isotonic":
        return _isotonic(known, truth, predictions)
    both = _with_truth(known, truth).select("label", "p", (F.col("label") == F.col("truth")).alias("hit"))
    rows = with_platt(picked, fit_platt(both))
    total = F.sum("p").over(own)
    return rows.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(1 / F.count("*").over(own)))


# --- stacking ---------------------------------------------------------------------------------------


@dataclass
class Stacked:
    """A multinomial model of the truth on all models' probabilities for each fold; a fold's model never saw its reads."""

    models: list[str]
    labels: list[int]
    folds: int
    weights: np.ndarray  # folds x (cells + 1) x labels, the last row is the intercept
    gradients: np.ndarray  # largest part of each fold's gradient, a place
    passes: int


def fold_of(read: Column, folds: int) -> Column:
    return F.pmod(F.xxhash64(read.cast("string")), F.lit(folds)).cast("int")


def _cells(predictions: DataFrame, models: list[str], labels: list[int], folds: int) -> DataFrame:
    """(read_id, pos, fold, cells, values): a place's probabilities with the number of their model and label."""
    model = F.array_position(F.array(*map(F.lit, models)), F.col("model")) - 1
    label = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col("label").cast("int")) - 1
    rows = predictions.select(*PLACE, model.alias("m"), label.alias("k"), F.col("p").cast("double").alias("p")).filter("m >= 0 and k >= 0 and p is not null")
    cell = F.struct((F.col("m") * len(labels) + F.col("k")).cast("int").alias("i"), "p")
    grouped = rows.groupBy(*PLACE).agg(F.sort_array(F.collect_list(cell)).alias("c"))
    return grouped.select(*PLACE, fold_of(F.col("read_id"), folds).alias("fold"), F.col("c.i").alias("cells"), F.col("c.p").alias("values"))


def _dense(batch: pa.RecordBatch, cells: int) -> np.ndarray:
    """Rows of all cells' probabilities (0 where there is none) and a 1."""
    out = np.zeros((batch.num_rows, cells + 1))
    lists = batch.column("cells")
    rows = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    out[rows, lists.flatten().to_numpy()] = batch.column("values").flatten().to_numpy()
    out[:, -1] = 1.0
    return out


def _shares(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = x @ weights
    z -= z.max(1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def fit_stack(
    predictions: DataFrame, truth: DataFrame, labels: list[int], folds: int = 5, ridge: float = 1.0, tolerance: float = 1e-8, most: int = 40
) -> Stacked:
    """Fits a model for each fold of reads (by a hash of the read) on the reads of all other folds.

    Minimised is the sum of -log p(truth) and ridge / 2 times the squared weights, the intercepts' left out. A pass adds up the
    likelihood and its first and second derivatives, for all folds at once, where places are read: a task hands on a row a
    fold. Newton steps that make a fold less likely are halved. Places whose truth is none of ``labels``
    don't count; a model's missing probability counts as 0.
    """
    models = sorted(r["model"] for r in at_most(predictions.select("model").distinct().filter("model is not null"), MOST_PARAMETERS, "models").collect())
    d, c = len(models) * len(labels) + 1, len(labels)
    if d * c > MOST_PARAMETERS:
        raise ValueError(f"more than {MOST_PARAMETERS} parameters")
    known = F.array_position(F.array(*[F.lit(k) for k in labels]), F.col("label").cast("int")) - 1
    own = truth.select(*PLACE, known.cast("int").alias("y")).filter("y >= 0")
    places = _cells(predictions, models, labels, folds).join(own, [*PLACE]).select("fold", "cells", "values", "y").persist(StorageLevel.MEMORY_AND_DISK)
    spark = predictions.sparkSession

    def sums(weights: np.ndarray) -> list[tuple[float, float, np.ndarray, np.ndarray]]:
        """Of each fold's model, over the other folds: places, -log-likelihood, gradient, second derivatives."""
        sent = spark.sparkContext.broadcast(weights)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((folds, 2 + d * c + (d * c) ** 2))
            for batch in batches:
                for start in range(0, batch.num_rows, 4_096):
                    part = batch.slice(start, 4_096)
                    x, y, fold = _dense(part, d - 1), part.column("y").to_numpy(), part.column("fold").to_numpy()
                    for f in range(folds):
                        use = fold != f
                        xf, yf = x[use], y[use]
                        q = _shares(xf, sent.value[f])
                        total[f, 0] += len(yf)
                        total[f, 1] -= np.log(np.maximum(q[np.arange(len(yf)), yf], 1e-300)).sum()
                        r = q.copy()
                        r[np.arange(len(yf)), yf] -= 1
                        total[f, 2 : 2 + d * c] += (xf.T @ r).ravel()
                        h = np.empty((d, c, d, c))
                        for a in range(c):
                            for b in range(a, c):
                                w = q[:, a] * ((a == b) - q[:, b])
                                h[:, a, :, b] = h[:, b, :, a] = xf.T @ (xf * w[:, None])
                        total[f, 2 + d * c :] += h.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["fold", "sums"])

        rows = places.mapInArrow(add, "fold int, sums array<double>").select("fold", F.posexplode("sums").alias("i", "x"))
        out = np.zeros((folds, 2 + d * c + (d * c) ** 2))
        for r in rows.groupBy("fold", "i").agg(F.sum("x").alias("x")).collect():
            out[r["fold"], r["i"]] = r["x"]
        return [(s[0], s[1], s[2 : 2 + d * c].reshape(d, c), s[2 + d * c :].reshape(d * c, d * c)) for s in out]

    weights, move = np.zeros((folds, d, c)), np.zeros((folds, d, c))
    best, gradients, left, passes = np.full(folds, np.inf), np.zeros(folds), np.ones(folds, bool), 0
    held = np.ones((d, 1)) * ridge
    held[-1] = 0.0
    try:
        while left.any() and passes < most:
            tried, passes = weights + move, passes + 1
            for f, (n, nll, g, h) in enumerate(sums(tried)):
                if not left[f]:
                    continue
                value = nll + 0.5 * float((held * tried[f] ** 2).sum())
                if value > best[f] + 1e-12 * abs(best[f]) and np.abs(move[f]).max() > 1e-12:
                    move[f] /= 2
                    continue
                weights[f], best[f] = tried[f], value
                g = g + held * weights[f]
                gradients[f] = np.abs(g).max() / max(1.0, n)
                left[f] = gradients[f] > tolerance
                # intercepts have one direction that changes nothing: the least step
                h = h + np.diag(np.repeat(held.ravel(), c))
                move[f] = -np.linalg.lstsq(h, g.ravel(), rcond=1e-12)[0].reshape(d, c)
        return Stacked(models, labels, folds, weights, gradients, passes)
    finally:
        places.unpersist()


def stacked(predictions: DataFrame, model: Stacked) -> DataFrame:
    """(read_id, pos, label, p): every read scored by the model of its fold. One shuffle, by place."""
    sent = predictions.sparkSession.sparkContext.broadcast(model.weights)
    cells, labels = len(model.models) * len(model.labels), model.labels
    rows = _cells(predictions, model.models, labels, model.folds)
    kinds = [rows.schema[c].dataType.simpleString() for c in PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, fold = _dense(batch, cells), batch.column("fold").to_numpy()
            q = np.empty((batch.num_rows, len(labels)))
            for f in np.unique(fold):
                q[fold == f] = _shares(x[fold == f], sent.value[f])
            at = pa.array(np.repeat(np.arange(batch.num_rows), len(labels)))
            columns = [batch.column(c).take(at) for c in PLACE]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.tile(labels, batch.num_rows), pa.int32()), pa.array(q.ravel())], [*PLACE, "label", "p"])

    return rows.mapInArrow(run, f"read_id {kinds[0]}, pos {kinds[1]}, label int, p double")
