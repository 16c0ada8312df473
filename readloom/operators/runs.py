"""Runs of labels: ghost resolution, run-length encoding, segments and boundaries.

Two forms. Over reads with label arrays everything is one fold per row, without a shuffle. Over the long
form (read, position, label) it is two windows over the same partitioning, hence one shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.draws import uniform
from readloom.functions.seq import let, letters
from readloom.schema import ARCHITECTURAL, BENIGN

RUN = "struct<label:string,start:int,end:int>"


def ghosted(labels: Column, through: Sequence[str] = BENIGN, exclude: Sequence[str] = ARCHITECTURAL) -> Column:
    """Labels with each benign error replaced by the last label before it that is neither benign nor excluded."""
    if not through:
        return labels
    fold = F.aggregate(
        labels,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("last")),
        lambda s, x: F.struct(
            F.concat(s["out"], F.array(F.when(x.isin(*through), F.coalesce(s["last"], x)).otherwise(x))).alias("out"),
            F.when(x.isin(*through, *exclude), s["last"]).otherwise(x).alias("last"),
        ),
    )
    return fold["out"]


def run_lengths(labels: Column) -> Column:
    """array<struct<label, start, end>> of maximal runs, half-open; linear in the labels."""
    return let(labels, lambda own: _merged(own, lambda i: F.get(own, i), lambda i: i, F.size(own)))


def _merged(items: Column, label: Callable[[Column], Column], start: Callable[[Column], Column], end: Column) -> Column:
    """Runs of neighbouring items with one label, where an item's place is its start and the last one ends at ``end``."""
    n = F.size(items)
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    firsts = F.filter(every, lambda i: (i == 0) | ~label(i).eqNullSafe(label(i - 1)))

    def build(at: Column) -> Column:
        def run(i: Column, k: Column) -> Column:
            after = F.get(at, k + 1)
            return F.struct(
                label(i).alias("label"), start(i).cast("int").alias("start"), F.coalesce(start(after), end).cast("int").alias("end")
            )

        return F.transform(at, run)

    return let(firsts, build)


def regions(labels: Column, through: Sequence[str] = BENIGN, exclude: Sequence[str] = ARCHITECTURAL) -> Column:
    """Runs after ghost resolution; excluded labels, and benign ones with nothing before them, break runs and are left out.

    Labels are first put into runs, so the fold that resolves ghosts goes over runs and not over bases.
    """

    def filled(first: Column) -> Column:
        names = ghosted(F.transform(first, lambda r: r["label"]), through, exclude)
        end = F.coalesce(F.try_element_at(first, F.lit(-1))["end"], F.lit(0))
        return let(names, lambda x: _merged(x, lambda i: F.get(x, i), lambda i: F.get(first, i)["start"], end))

    return F.filter(let(run_lengths(labels), filled), lambda r: ~r["label"].isin(*through, *exclude))


def segments(labels: Column, n: Column, drop: Sequence[str] = ("PAD",)) -> Column:
    """Runs within the read's own n places; dropped labels still break runs."""
    return F.filter(run_lengths(F.slice(labels, F.lit(1), n)), lambda r: ~r["label"].isin(*drop))


def last_boundaries(runs: Column) -> Column:
    """label -> (start, end) of its last run. Duplicates are resolved here, so no session setting is needed."""
    names = F.array_distinct(F.transform(runs, lambda r: r["label"]))
    return F.map_from_arrays(
        names,
        F.transform(names, lambda n: F.try_element_at(F.filter(runs, lambda r: r["label"] == n), F.lit(-1)).dropFields("label")),
    )


def slice_of(seq: Column, boundaries: Column, label: str) -> Column:
    """The part of a sequence that a label covers; null where the label isn't there."""
    at = F.try_element_at(boundaries, F.lit(label))
    return F.substring(seq, at["start"] + 1, at["end"] - at["start"])


def instances(sequence: Column, runs: Column, label: str) -> Column:
    """The bases of every run of a label, in order: structs (start, end, bases)."""
    own = F.filter(runs, lambda r: r["label"] == label)
    bases = lambda r: F.substring(sequence, r["start"] + 1, r["end"] - r["start"])
    return F.transform(own, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), bases(r).alias("bases")))


def lengths_of(runs: Column, label: str) -> Column:
    return F.transform(F.filter(runs, lambda r: r["label"] == label), lambda r: r["end"] - r["start"])


def _first(runs: Column, label: str) -> Column:
    return F.try_element_at(F.filter(runs, lambda r: r["label"] == label), F.lit(1))


def _cut(values: Column, run: Column, copies: int) -> Column:
    part = F.slice(values, run["start"] + 1, run["end"] - run["start"])
    before = F.slice(values, F.lit(1), run["start"])
    after = F.slice(values, run["end"] + 1, F.size(values))
    return F.when(run.isNull(), values).otherwise(F.concat(before, *[part] * copies, after))


def remove_segment(reads: DataFrame, label: str) -> DataFrame:
    """Bases and labels without the first run of ``label``; reads without one stay as they are."""
    run = _first(run_lengths(F.col("labels")), label)
    return _both(reads, lambda v: _cut(v, run, 0))


def duplicate_segment(reads: DataFrame, label: str, copies: int = 1) -> DataFrame:
    """The first run of ``label`` repeated in place."""
    run = _first(run_lengths(F.col("labels")), label)
    return _both(reads, lambda v: _cut(v, run, 1 + copies))


def shuffle_middle(reads: DataFrame, seed: int) -> DataFrame:
    """The first and last run stay, those between are put into an order drawn by hash; under four runs nothing changes."""
    row = F.col("read_id")

    def mixed(found: Column) -> Column:
        n = F.size(found)
        key = F.transform(
            found,
            lambda r, i: F.struct(
                F.when(i == 0, -1.0).when(i == n - 1, 2.0).otherwise(uniform(seed, row, "middle", i)).alias("k"), i.alias("i"), r.alias("r")
            ),
        )
        return F.when(n >= 4, F.transform(F.array_sort(key), lambda x: x["r"])).otherwise(found)

    order = let(run_lengths(F.col("labels")), mixed)

    def change(values: Column) -> Column:
        return F.flatten(F.transform(order, lambda r: F.slice(values, r["start"] + 1, r["end"] - r["start"])))

    return _both(reads, change)


def truncate(reads: DataFrame, fraction: float) -> DataFrame:
    n = F.floor(F.size("labels") * F.lit(fraction)).cast("int")
    return _both(reads, lambda v: F.slice(v, F.lit(1), n))


def _both(reads: DataFrame, change) -> DataFrame:
    new = F.array_join(change(letters(F.col("sequence"))), "")
    return reads.withColumns({"sequence": new, "labels": change(F.col("labels"))})


# --- long form ------------------------------------------------------------------------------------


def bases(reads: DataFrame) -> DataFrame:
    """(read_id, pos, base, label)."""
    pairs = F.arrays_zip(letters(F.col("sequence")).alias("base"), F.col("labels").alias("label"))
    return reads.select("read_id", F.posexplode(pairs).alias("pos", "x")).select("read_id", "pos", "x.base", "x.label")


def ghost_fill(rows: DataFrame, through: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``label`` with benign labels filled from the last valid one before them in the read."""
    valid = F.when(~F.col("label").isin(*through, *exclude), F.col("label"))
    before = Window.partitionBy("read_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.coalesce(F.last(valid, ignorenulls=True).over(before), F.col("label"))
    return rows.withColumn("label", F.when(F.col("label").isin(*through), filled).otherwise(F.col("label")))


def long_runs(rows: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(read_id, label, start, end, n) of maximal runs; excluded labels break runs and are left out."""
    order = Window.partitionBy("read_id").orderBy("pos")
    change = F.when(F.lag("label").over(order).eqNullSafe(F.col("label")), 0).otherwise(1)
    marked = rows.withColumn("_new", change).withColumn("_run", F.sum("_new").over(order))
    runs = marked.groupBy("read_id", "_run", "label").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))
    runs = runs.select("read_id", "label", "start", "end", (F.col("end") - F.col("start")).alias("n"))
    return runs.filter(~F.col("label").isin(*exclude)) if exclude else runs


def boundaries(rows: DataFrame) -> DataFrame:
    """(read_id, pos, before, label) where the label differs from the one before it."""
    order = Window.partitionBy("read_id").orderBy("pos")
    marked = rows.select("read_id", "pos", F.lag("label").over(order).alias("before"), "label")
    return marked.filter(F.col("before") != F.col("label"))
