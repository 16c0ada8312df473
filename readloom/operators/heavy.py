"""The most frequent values, exactly, without shuffling every distinct one.

Each task keeps a summary of a bounded number of counters; when there are too many, all are lowered by what the smallest ones hold
and those that reach nothing are dropped. So a counter is too low by at most what was taken off in its task, and no value that has
none occurred more often than that. Summaries add up. If the k-th largest lower bound is above the sum of what was taken off, only
values whose upper bound reaches it can be among the k most frequent: these candidates, which the summaries' size bounds, are then counted
exactly. Where the distribution is too flat for such a proof, every value is counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a task, and candidates that are sent to every task.
COUNTERS, CANDIDATES = 20_000, 200_000


def summaries(rows: DataFrame, col: str, counters: int = COUNTERS) -> DataFrame:
    """(value, low, off): each task's counters of the values' text, and a row with a null value for what it has taken off them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        off = 0
        for batch in batches:
            counted = pc.value_counts(batch.column(0).drop_null())
            for value, n in zip(counted.field("values").to_pylist(), counted.field("counts").to_pylist()):
                held[value] = held.get(value, 0) + n
            if len(held) > 2 * counters:
                cut = sorted(held.values(), reverse=True)[counters]
                held = {v: n - cut for v, n in held.items() if n > cut}
                off += cut
        values = [*held, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(values, pa.string()), pa.array([*held.values(), 0], pa.int64()), pa.array([0] * len(held) + [off], pa.int64())], ["value", "low", "off"]
        )

    return rows.select(F.col(col).cast("string").alias("value")).mapInArrow(run, "value string, low long, off long")


def most_frequent(rows: DataFrame, col: str, k: int, counters: int = COUNTERS) -> DataFrame:
    """(col, n): the k most frequent values with their exact counts, of equal counts the ones that sort first. Nulls don't count.

    ``rows`` is read twice. What is shuffled is bounded by ``counters`` and the number of tasks, unless the fallback is taken.
    """
    kind = rows.schema[col].dataType.simpleString()
    parts = summaries(rows, col, counters).groupBy("value").agg(F.sum("low").alias("low"), F.sum("off").alias("off")).persist()
    try:
        off = parts.filter("value is null").agg(F.coalesce(F.sum("off"), F.lit(0))).first()[0]
        top = parts.filter("value is not null").orderBy(F.desc("low")).select("low").limit(k).collect()
        floor = top[-1]["low"] if len(top) == k else 0
        chosen = None
        if off == 0 or floor > off:
            chosen = [r["value"] for r in parts.filter("value is not null").filter(F.col("low") + off >= floor).limit(CANDIDATES + 1).select("value").collect()]
    finally:
        parts.unpersist()
    counted = rows.filter(F.col(col).isNotNull())
    if chosen is not None and len(chosen) <= CANDIDATES:
        spark = rows.sparkSession
        table = spark.createDataFrame(pa.table({"_value": pa.array(chosen, pa.string())})).withColumn("_value", F.col("_value").cast(kind))
        counted = counted.join(F.broadcast(table), F.col(col) == F.col("_value"), "left_semi")
    return counted.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)
