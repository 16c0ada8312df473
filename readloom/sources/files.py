"""Helpers of the sources: files of this machine, and lines that Spark's text reader gives in parts."""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator
from typing import IO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import InputPartition


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def paths(pattern: str, default: str) -> list[str]:
    """Files of a path: itself, all that match a glob, or those of a folder that match ``default``."""
    if os.path.isdir(pattern):
        pattern = os.path.join(pattern, default)
    found = sorted(p for p in glob.glob(pattern) if os.path.isfile(p))
    if not found:
        raise FileNotFoundError(pattern)
    return found


def opened(path: str) -> IO[str]:
    return gzip.open(path, "rt", encoding="utf-8", newline="\n") if path.endswith(".gz") else open(path, encoding="utf-8", newline="\n")


def lines(path: str) -> Iterator[str]:
    with opened(path) as file:
        for line in file:
            yield line.rstrip("\r\n")


def _key() -> Column:
    return F.xxhash64("_metadata.file_path", "_metadata.file_block_start")


def part_lines(spark: SparkSession, path: str, line_end: str | None = None, *more: Column) -> DataFrame:
    """(key, value): lines of files and a number of the part of a file that each is in, which is cheaper to send along than its name."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    return reader.text(path).select(_key().alias("key"), "value", *more)


def part_table(spark: SparkSession, path: str, *sums: Column, line_end: str | None = None) -> DataFrame:
    """(key, file, part, size, ...): a row for each part of a file with sums over its lines (value, and line, a rising number)."""
    reader = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    places = ("_metadata.file_path", "_metadata.file_block_start", "_metadata.file_size")
    rows = reader.text(path).select(_key().alias("key"), *places, "value", F.monotonically_increasing_id().alias("line"))
    places = [F.first(c).alias(name) for c, name in (("file_path", "file"), ("file_block_start", "part"), ("file_size", "size"))]
    return rows.groupBy("key").agg(*places, *sums)


def stretches(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Array]]:
    """(key, lines) of a batch's stretches of one part."""
    if not batch.num_rows:
        return
    key = batch.column("key").to_numpy()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows]):
        yield int(key[a]), batch.column("value").slice(a, b - a)
