"""FASTQ: a data source (one partition a file), a reader through Spark's text source, and a per-sample writer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from readloom.sources.files import FilePartition, lines, part_lines, part_table, paths, stretches

SCHEMA = "read_id string, sequence string, quality string, file string"
BATCH = 4_096


class FastqSource(DataSource):
    """``spark.read.format("fastq").load(path or glob or folder)``; option ``max_reads`` stops each file early.

    For files of this machine, a task each; ``read_split`` reads files in parts and from any store.
    """

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.files = paths(options["path"], options.get("pathGlobFilter", "*.f*q*"))
        self.most = int(options.get("max_reads", 0)) or None

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in self.files]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for i, record in enumerate(records(lines(partition.path))):
            if self.most is not None and i >= self.most:
                break
            rows.append((*record, partition.path))
            if len(rows) >= BATCH:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def records(source: Iterator[str]) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) of four-line records; a broken record raises."""
    for head in source:
        if not head:
            continue
        seq, plus, quality = next(source, ""), next(source, ""), next(source, "")
        if not head.startswith("@") or not plus.startswith("+") or len(seq) != len(quality):
            raise ValueError(f"not a FASTQ record: {head[:80]}")
        yield head[1:].split(None, 1)[0] if len(head) > 1 else "", seq, quality


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], ["read_id", "sequence", "quality", "file"])


#: Parts of input files whose line counts may be sent to every task (about 200 bytes each).
MOST_PARTS = 500_000


def read_split(spark: SparkSession, path: str, most_per_file: int | None = None) -> DataFrame:
    """The same columns, from any store that Spark reads, large files in parts; no read is shuffled.

    Lines of each part of a file are counted first, a number a part; so each line's number in its file is known and
    with it its place in a four-line record, whatever it starts with. Records are put together where their
    lines are read; only those that a part's border cuts are brought together. A record that isn't one raises.
    ``most_per_file``: only so many records from the start of each file.
    """
    most = 1 << 62 if most_per_file is None else most_per_file
    counts = part_table(spark, path, F.count("*").alias("n"), F.min("line").alias("line"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    places = counts.select("key", "file", "n", "line", before.alias("first")).limit(MOST_PARTS + 1).collect()
    if len(places) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of files; read them in several calls")
    sent = spark.sparkContext.broadcast({r["key"]: r["first"] for r in places})

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Part | None = None  # a part's lines come in order, to one task
        for batch in batches:
            for key, lines in stretches(batch):
                if own is None or own.key != key:
                    own = _Part(key, sent.value[key], most)
                yield from own.feed(lines)

    files = F.broadcast(spark.createDataFrame(places, "key long, file string, n long, line long, first long"))
    whole = part_lines(spark, path).mapInArrow(assembled, "key long, head string, seq string, plus string, qual string").join(files.select("key", "file"), "key")
    # a part's lines before its first whole record, and after its last one
    edges = part_lines(spark, path, None, F.monotonically_increasing_id().alias("at")).join(files, "key")
    at, end = F.col("at") - F.col("line"), F.col("first") + F.col("n")
    edges = edges.filter((at < F.pmod(-F.col("first"), F.lit(4))) | (at >= F.col("n") - end % 4))
    number = F.col("first") + at
    lines_of = [F.max(F.when(number % 4 == i, F.col("value"))).alias(c) for i, c in enumerate(_COLUMNS)]
    edges = edges.filter(F.floor(number / 4) < most)
    cut = edges.groupBy("file", F.floor(number / 4).alias("record")).agg(*lines_of).select("file", *_COLUMNS)
    cut = cut.filter(F.coalesce(F.concat_ws("", *_COLUMNS), F.lit("")) != "")  # blank lines at a file's end
    every = whole.filter("head <> '' or seq <> '' or plus <> '' or qual <> ''").select("file", *_COLUMNS).union(cut)
    fine = F.startswith("head", F.lit("@")) & F.startswith("plus", F.lit("+")) & (F.length("seq") == F.length("qual"))
    refused = F.raise_error(F.concat(F.lit("not a FASTQ record: "), F.left(F.coalesce("head", F.lit("")), F.lit(80)))).cast("string")
    name = F.regexp_extract("head", r"^@(\S*)", 1)
    return every.select(F.when(F.coalesce(fine, F.lit(False)), name).otherwise(refused).alias("read_id"), F.col("seq").alias("sequence"), F.col("qual").alias("quality"), "file")


_COLUMNS = ("head", "seq", "plus", "qual")


class _Part:
    """One part's lines, in order: those of records that are whole in it, by four."""

    def __init__(self, key: int, line: int, most: int):
        self.key, self.skip = key, -line % 4
        self.room = most - (line + self.skip) // 4  # records of the file that are still wanted
        self.left: pa.Array | None = None

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        if self.skip:
            skipped = min(self.skip, len(lines))
            self.skip, lines = self.skip - skipped, lines.slice(skipped)
        if self.left is not None:
            lines, self.left = pa.concat_arrays([self.left, lines]), None
        n = min(len(lines) // 4, self.room)
        if n > 0:
            self.room -= n
            at = np.arange(0, 4 * n, 4)
            columns = [lines.take(pa.array(at + i)) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(self.key, pa.int64()), n), *columns], ["key", *_COLUMNS])
        if self.room > 0 and len(lines) > 4 * n:
            self.left = lines.slice(4 * n)


def record_rows(reads: DataFrame) -> DataFrame:
    """(value): the four lines of each read."""
    return reads.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), "sequence", F.lit("+"), "quality").alias("value"))


def write_by_sample(reads: DataFrame, path: str, compress: bool = True) -> None:
    """One folder a sample, with four-line records; reads of a large sample are written by many tasks."""
    record = F.concat_ws("\n", F.concat(F.lit("@"), F.col("read_id").cast("string")), "sequence", F.lit("+"), "quality")
    out = reads.select(record.alias("value"), F.col("sample_name").alias("sample"))
    out.write.partitionBy("sample").option("compression", "gzip" if compress else "none").mode("overwrite").text(path)
