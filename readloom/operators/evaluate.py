"""Evaluation: confusion, precision and recall, boundary accuracy, constraint satisfaction and robustness."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.sizes import at_most
from readloom.operators.runs import duplicate_segment, remove_segment, shuffle_middle, truncate

#: Labels with bounds, which are sent to every task.
MOST_BOUNDS = 100_000


def confusion(pairs: DataFrame, normalize: bool = False) -> DataFrame:
    """(truth, label, n) and, if asked for, each count's share of its truth."""
    n = pairs.groupBy("truth", "label").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("truth"))) if normalize else n


def per_class(pairs: DataFrame, pad: str | int | None = None) -> DataFrame:
    """(class, tp, fp, fn, support, precision, recall, f1); places whose truth is ``pad`` are left out."""
    if pad is not None:
        pairs = pairs.filter(F.col("truth") != F.lit(pad))
    n = confusion(pairs)
    hit = F.col("truth") == F.col("label")
    sides = n.select(
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("class"), F.when(hit, F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(hit, 0).otherwise(F.col("n")).alias("fn")),
                F.struct(F.col("label").alias("class"), F.lit(0).cast("long").alias("tp"), F.when(hit, 0).otherwise(F.col("n")).alias("fp"), F.lit(0).cast("long").alias("fn")),
            )
        ).alias("x")
    ).select("x.*")
    sums = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))

    def share(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(
        "class", "tp", "fp", "fn", (tp + fn).alias("support"), share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1")
    )


def weighted_scores(classes: DataFrame) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 weighted by support."""
    w = F.sum("support")
    means = [F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), w), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]
    return classes.agg(F.coalesce(F.try_divide(F.sum("tp").cast("double"), w), F.lit(0.0)).alias("accuracy"), *means)


def report(pairs: DataFrame, pad: str | int | None = None) -> DataFrame:
    """(segment, metric, value): each segment's precision, recall, F1 and support, and the weighted scores as segment null."""
    classes = per_class(pairs, pad)
    own = _long(classes.select(F.col("class").cast("string").alias("segment"), "precision", "recall", "f1", "support"))
    return own.union(_long(weighted_scores(classes).select(F.lit(None).cast("string").alias("segment"), "accuracy", "precision", "recall", "f1")))


def _long(rows: DataFrame) -> DataFrame:
    """A row for each column but the first, which is kept."""
    first, *metrics = rows.columns
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return rows.select(first, F.explode(cells).alias("x")).select(first, "x.*")


def matched_runs(truth: DataFrame, found: DataFrame, tolerance: int = 2) -> DataFrame:
    """True runs (read_id, label, start, end) of which a found run of the same label has both ends within ``tolerance``.

    Starts are put into bins of the tolerance's width; a found run goes to the three bins that it can match
    from, so the range join is an equi-join however long reads are.
    """
    width = tolerance + 1
    near = found.select("read_id", "label", F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.array(*[F.floor(F.col("start") / width) + i for i in (-1, 0, 1)])).alias("bin"))
    own = truth.withColumn("bin", F.floor(F.col("start") / width))
    close = (F.abs(F.col("start") - F.col("s")) <= tolerance) & (F.abs(F.col("end") - F.col("e")) <= tolerance)
    same = (own["read_id"] == near["read_id"]) & (own["label"] == near["label"]) & (own["bin"] == near["bin"]) & close
    return own.join(near, same, "left_semi").drop("bin")


def matched_boundaries(found: DataFrame, truth: DataFrame, tolerance: int = 3) -> DataFrame:
    """Found boundaries (read_id, pos) with a true one within ``tolerance``."""
    width = tolerance + 1
    near = truth.select("read_id", F.col("pos").alias("t"), F.explode(F.array(*[F.floor(F.col("pos") / width) + i for i in (-1, 0, 1)])).alias("bin"))
    own = found.withColumn("bin", F.floor(F.col("pos") / width))
    same = (own["read_id"] == near["read_id"]) & (own["bin"] == near["bin"]) & (F.abs(F.col("pos") - F.col("t")) <= tolerance)
    return own.join(near, same, "left_semi").drop("bin")


def satisfaction(runs: DataFrame, bounds: DataFrame) -> DataFrame:
    """One row for each bounded label: runs, share within bounds, share equal to the lower bound, and their lengths.

    Bounds, a row a label, go to the runs, which are added up where they are: no run is shuffled, however common its label.
    """
    n = F.col("n")
    bounds = at_most(bounds.select("label", "min_len", "max_len").distinct(), MOST_BOUNDS, "bounded labels")
    joined = runs.select("label", "n").join(F.broadcast(bounds), "label")
    ok = n.between(F.col("min_len"), F.col("max_len"))
    found = joined.groupBy("label", "min_len", "max_len").agg(
        F.count("n").alias("runs"),
        F.avg(ok.cast("double")).alias("satisfied"),
        F.avg((n == F.col("min_len")).cast("double")).alias("exact"),
        F.count_if(~ok).alias("violations"),
        F.avg("n").alias("mean"),
        F.stddev_pop("n").alias("std"),
        F.min("n").alias("shortest"),
        F.max("n").alias("longest"),
    )
    every = bounds.join(found, ["label", "min_len", "max_len"], "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("runs", "violations")]
    shares = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("satisfied", "exact")]
    return every.select("label", "min_len", "max_len", counts[0], *shares, counts[1], "mean", "std", "shortest", "longest")


def length_statistics(rows: DataFrame, n: str = "n", by: Sequence[str] = ()) -> DataFrame:
    out = [F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"), F.median(n).alias("median"), F.count(n).alias("count")]
    return rows.groupBy(*by).agg(*out)


def distribution(rows: DataFrame, col: str) -> DataFrame:
    """(col, n, share), every value's count and its share of all."""
    n = rows.groupBy(col).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # a row for each distinct value


def error_histogram(reads: DataFrame) -> DataFrame:
    """(error_type, n, share of all reads) of reads that have an error type."""
    n = reads.groupBy("error_type").agg(F.count("*").alias("n"))
    every = Window.partitionBy()  # a row a type
    return n.withColumn("share", F.col("n") / F.sum("n").over(every)).filter("error_type is not null")


def variants(reads: DataFrame, labels: Sequence[str], seed: int = 0) -> DataFrame:
    """Reads and their corrupted forms, told apart by ``variant``: each label's segment
    lost or doubled, cut reads, and reads whose middle is shuffled."""
    out = reads.withColumn("variant", F.lit("valid"))
    for label in labels:
        out = out.unionByName(remove_segment(reads, label).withColumn("variant", F.lit(f"missing_{label}")))
        out = out.unionByName(duplicate_segment(reads, label).withColumn("variant", F.lit(f"duplicated_{label}")))
    for fraction in (0.5, 0.75):
        out = out.unionByName(truncate(reads, fraction).withColumn("variant", F.lit(f"truncated_{fraction}")))
    return out.unionByName(shuffle_middle(reads, seed).withColumn("variant", F.lit("chimera")))


def degradation(accuracies: DataFrame, baseline: str = "valid") -> DataFrame:
    """(variant, accuracy, degradation, ratio) against the baseline's accuracy; a row for each variant."""
    base = F.max(F.when(F.col("variant") == baseline, F.col("accuracy"))).over(Window.partitionBy())
    return accuracies.select("variant", "accuracy", (base - F.col("accuracy")).alias("degradation"), F.try_divide(F.col("accuracy"), base).alias("ratio"))


def robustness_findings(
    accuracies: DataFrame, least: float = 0.7, by_variant: Mapping[str, float] | None = None, groups: Mapping[str, float] | None = None
) -> DataFrame:
    """(rule, name, accuracy, least): what of a table (variant, accuracy) falls below its bound.

    ``worst``: the variant with the least accuracy, against ``least``; ``variant``: variants with a bound of their
    own; ``group``: the mean of all variants whose name begins with a prefix.
    """
    worst = accuracies.agg(F.min(F.struct("accuracy", "variant")).alias("x")).select(F.lit("worst").alias("rule"), F.col("x.variant").alias("name"), F.col("x.accuracy").alias("accuracy"), F.lit(least).alias("least"))
    found = worst
    for name, bound in (by_variant or {}).items():
        own = accuracies.filter(F.col("variant") == name)
        found = found.union(own.select(F.lit("variant"), "variant", "accuracy", F.lit(bound)))
    for prefix, bound in (groups or {}).items():
        own = accuracies.filter(F.startswith("variant", F.lit(prefix))).agg(F.avg("accuracy").alias("accuracy"))
        found = found.union(own.select(F.lit("group"), F.lit(prefix), "accuracy", F.lit(bound)))
    return found.filter(F.col("accuracy") < F.col("least"))


def robustness_extremes(rows: DataFrame) -> DataFrame:
    """One row: the segments whose accuracy varies least and most over variants (sample variance)."""
    v = rows.groupBy("segment").agg(F.var_samp("accuracy").alias("v"))
    return v.agg(F.min_by("segment", F.struct("v", "segment")).alias("most_robust"), F.max_by("segment", F.struct("v", "segment")).alias("least_robust"))


def best_models(scores: DataFrame, criteria: Mapping[str, bool]) -> DataFrame:
    """(criterion, model, value): the best model of each column; True: the highest counts."""
    aggs = [
        (F.max_by if high else F.min_by)(F.struct("model", F.col(c).cast("double").alias("value")), F.col(c)).alias(c) for c, high in criteria.items()
    ]
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("criterion"), F.col(f"`{c}`.model").alias("model"), F.col(f"`{c}`.value").alias("value")) for c in criteria]))
    return scores.agg(*aggs).select(stacked.alias("x")).select("x.*")


def smooth(rows: DataFrame, by: str, order: Sequence[str], value: str, factor: float) -> DataFrame:
    """(by, pos, value, smoothed): s_0 = v_0, s_i = factor * s_{i-1} + (1 - factor) * v_i.

    The recursion unrolls to a discounted sum, so it is a window and no list is gathered: with positions
    from the start, weights grow by 1/factor and are scaled back by a stretch that keeps them finite.
    """
    ordered = Window.partitionBy(by).orderBy(*order)
    placed = rows.select(by, F.row_number().over(ordered).alias("pos"), F.col(value).cast("double").alias("value"))
    stretch = 64  # 1 / factor ** 64 stays a double for factors down to 1e-4
    block = F.floor((F.col("pos") - 1) / stretch).cast("int")
    k = (F.col("pos") - 1) % stretch
    weight = F.when(F.col("pos") == 1, 1.0).otherwise(1 - factor)
    within = Window.partitionBy(by, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = placed.withColumn("block", block).withColumn("k", k)
    part = part.withColumn("own", F.sum(weight * F.col("value") * F.pow(F.lit(1 / factor), F.col("k"))).over(within) * F.pow(F.lit(factor), F.col("k")))
    ends = part.groupBy(by, "block").agg(F.max_by("own", "pos").alias("own"))
    # what earlier blocks leave at a block's start: their ends, discounted block by block
    before = Window.partitionBy(by).orderBy("block")
    far = factor**stretch
    reach = max(1, math.ceil(37 / -math.log(far)))  # blocks further back weigh less than a double's last digit
    steps = ends.withColumn("ends", F.collect_list("own").over(before.rowsBetween(-reach, -1)))
    carry = F.aggregate("ends", F.lit(0.0), lambda a, v: a * far + v)
    carried = steps.select(by, "block", carry.alias("carry"))
    joined = part.join(carried, [by, "block"])
    return joined.select(by, "pos", "value", (F.col("own") + F.col("carry") * F.pow(F.lit(factor), F.col("k") + 1)).alias("smoothed"))
