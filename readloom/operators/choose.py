"""Choosing rows: the first of each file, a share by number, a fixed sample."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def capped(rows: DataFrame, per_file: int, in_all: int, order: str = "read_id") -> DataFrame:
    """The first ``per_file`` rows of each file, ``in_all`` of them together; both are what is asked for."""
    first = Window.partitionBy("file").orderBy(order)
    return rows.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= per_file).drop("_n").orderBy("file", order).limit(in_all)


def split(reads: DataFrame, n: int, fraction: float) -> tuple[DataFrame, DataFrame]:
    """The first int(n * fraction) reads and the rest, by their number."""
    border = int(n * fraction)
    return reads.filter(F.col("read_id") < border), reads.filter(F.col("read_id") >= border)


def hash_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows without replacement, always the same ones: the least hashes, kept by a bounded top-n."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")).cast("binary"))
    return rows.orderBy(digest, key).limit(n)
