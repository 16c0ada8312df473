"""Helpers that the corpus operators share: tables, shared storage, word rules, Arrow plumbing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from readloom.functions import scratch

#: A-Z are lower-cased, every other ASCII byte that is no digit or letter becomes a space; bytes of
#: non-ASCII characters stay. The length never changes, so offsets are those of the original bytes.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as Parquet into the shared folder and reads it back.

    ``replaces``: an earlier such table that nothing needs any more once this one is there; it is removed. The rest goes
    when the process ends.
    """
    spark = df.sparkSession
    path = scratch.place(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if replaces is not None:
        scratch.remove(replaces.written_at)
    return out


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores before it until it is none of ``taken`` (letter case aside)."""
    there = {t.lower() for t in taken}
    while name.lower() in there:
        name = "_" + name
    return name


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding."""
    return column.cast(pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cuts record batches so that ``column`` holds about ``most`` bytes at once (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(
            pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float)
        )
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0.0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
