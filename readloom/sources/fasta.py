"""FASTA: a data source with byte offsets, a reader through Spark's text source, and the index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from readloom.sources.files import FilePartition, opened, part_lines, part_table, paths, stretches

SCHEMA = "name string, header string, sequence string, offset long, line_bases int, line_width int, file string"
#: A batch is handed on at so many bases or records, whichever comes first.
BATCH_BASES, BATCH_ROWS = 4_000_000, 10_000
INDEX = "name string, length long, offset long, line_bases int, line_width int"


class FastaSource(DataSource):
    """``spark.read.format("fasta").load(path)``: a row a record, with the place of its first base in the text.

    For files of this machine, a task each; ``read_split`` reads files in parts and from any store.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastaReader:
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options):
        self.files = paths(options["path"], options.get("pathGlobFilter", "*.f*a*"))

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in self.files]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 3 + [pa.int64(), pa.int32(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for record in records(partition.path):
            rows.append((*record, partition.path))
            held += len(record[2])
            if held >= BATCH_BASES or len(rows) >= BATCH_ROWS:
                yield _batch(rows, kinds, names)
                rows, held = [], 0
        if rows:
            yield _batch(rows, kinds, names)


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names)


def records(path: str) -> Iterator[tuple[str, str, str, int, int, int]]:
    header, parts, at, start, bases, width = None, [], 0, 0, 0, 0
    with opened(path) as file:
        for line in file:
            raw, text = len(line.encode()), line.rstrip("\r\n")
            if text.startswith(">"):
                if header is not None:
                    yield _record(header, parts, start, bases, width)
                header, parts, start, bases, width = text[1:], [], at + raw, 0, 0
            elif header is not None and text:
                if not parts:
                    bases, width = len(text), raw
                parts.append(text)
            at += raw
    if header is not None:
        yield _record(header, parts, start, bases, width)


def _record(header: str, parts: list[str], *numbers: int) -> tuple:
    return (header.split(None, 1)[0] if header.strip() else "", header, "".join(parts), *numbers)


#: Parts of input files whose summaries may be sent to every task (about 250 bytes each).
MOST_PARTS = 500_000
_PIECE = "key long, record long, header string, sequence string, offset long, line_bases int, line_width int, whole boolean"
_PIECE_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]


def part_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(key, file, part, at, records, size): where each part's first line starts and how many records start before it.

    A part is summed up by its bytes and headers; sums of all parts before give it its place, whatever task reads it.
    """
    own = [F.sum(F.octet_length("value").cast("long") + 1).alias("bytes"), F.count_if(F.startswith("value", F.lit(">"))).alias("headers")]
    sums = part_table(spark, path, *own, line_end="\n")  # only the line feed is taken off, so bytes add up
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at, records = (F.sum(c).over(before) - F.col(c) for c in ("bytes", "headers"))
    return sums.select("key", "file", "part", at.alias("at"), records.alias("records"), "size")


class _Part:
    """One part's lines, in order: records that start and end in it are handed on whole, what its borders cut as pieces."""

    def __init__(self, key: int, at: int, records: int, end: int):
        self.key, self.at, self.record, self.end = key, at, records, end
        self.header: str | None = None
        self.texts: list[bytes] = []
        self.numbers: tuple[int | None, int | None, int | None] = (None, None, None)

    def _batch(self, records: list, headers: list, texts, offsets: list, bases: list, widths: list, whole: bool) -> pa.RecordBatch:
        n = len(records)
        columns = [[self.key] * n, records, headers, texts, offsets, bases, widths, [whole] * n]
        return pa.RecordBatch.from_arrays(
            [c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, _PIECE_KINDS)], [c.split()[0] for c in _PIECE.split(", ")]
        )

    def close(self, whole: bool) -> Iterator[pa.RecordBatch]:
        """The record that is open; lines before a file's first header belong to none."""
        if self.record and (self.header is not None or any(self.texts)):
            text = pa.array([b"".join(self.texts)], pa.binary()).cast(pa.string())
            yield self._batch([self.record], [self.header], text, *([x] for x in self.numbers), whole and self.header is not None)
        self.header, self.texts, self.numbers = None, [], (None, None, None)

    def feed(self, lines: pa.Array) -> Iterator[pa.RecordBatch]:
        raw = pc.binary_length(lines).to_numpy().astype(np.int64) + 1
        starts = self.at + np.cumsum(raw) - raw
        self.at += int(raw.sum())
        if pc.any(pc.ends_with(lines, "\r")).as_py():
            lines = pc.ascii_rtrim(lines, "\r")
        head = pc.starts_with(lines, ">")
        bare = pc.or_(pc.or_(head, pc.starts_with(lines, ";")), pc.ascii_is_space(lines))
        lines, head = lines.cast(pa.large_string()), head.to_numpy(zero_copy_only=False)
        bases = pc.if_else(bare, pa.scalar("", pa.large_string()), lines)
        data, edges = _buffer(bases)
        sizes = np.diff(edges)
        full = np.flatnonzero(sizes)  # lines with bases
        widths = np.minimum(raw, self.end - starts)
        at = np.flatnonzero(head)
        ends = np.append(at, len(raw))
        # what goes on from before
        if ends[0]:
            self.texts.append(data[edges[0] : edges[ends[0]]])
            if self.numbers[1] is None and len(full) and full[0] < ends[0]:
                self.numbers = (self.numbers[0], int(sizes[full[0]]), int(widths[full[0]]))
        if not len(at):
            return
        yield from self.close(True)
        headers = pc.utf8_slice_codeunits(lines.take(pa.array(at)), 1).cast(pa.string())
        offsets = starts[at] + raw[at]
        first = np.searchsorted(full, at)
        there = first < len(full)
        there[there] = full[first[there]] < ends[1:][there]
        shown = full[np.minimum(first, len(full) - 1)] if len(full) else np.zeros(len(at), np.int64)
        line_bases, line_width = (pa.array(np.where(there, x[shown] if len(x) else 0, 0).astype(np.int32), mask=~there) for x in (sizes, widths))
        n = len(at) - 1
        if n:
            text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(edges[at].astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.string())
            records = pa.array(self.record + 1 + np.arange(n))
            yield self._batch(records, headers.slice(0, n), text, pa.array(offsets[:n]), line_bases.slice(0, n), line_width.slice(0, n), True)
        self.record += len(at)
        self.header, self.texts = headers[n].as_py(), [data[edges[at[n]] : edges[-1]]]
        self.numbers = (int(offsets[n]), line_bases[n].as_py(), line_width[n].as_py())


def _buffer(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """Bytes of a large string array, and where each of its values starts in them, with the end."""
    _, offsets, data = strings.buffers()
    edges = np.frombuffer(offsets, np.int64, len(strings) + 1, strings.offset * 8)
    return (data.to_pybytes() if data is not None else b""), edges


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(name, header, sequence, offset, line_bases, line_width, file) from any store, large files in parts.

    Parts are summed up first (bytes and headers, a row a part), so every part knows the offset of its first line and the
    number of its first record. Records are put together where their lines are read; of those that a part's border cuts,
    the pieces are brought together. A name is the header's first word; line ends may be those of Windows; blank lines and
    lines that start with ``;`` hold no bases, nor do lines before the first header. Offsets are those of the text, of
    compressed files too, which are read by one task each. A record without bases has no line_bases and line_width.
    """
    places = part_summaries(spark, path).limit(MOST_PARTS + 1).collect()
    if len(places) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of files; read them in several calls")
    # a compressed file's size says nothing of its text
    sent = spark.sparkContext.broadcast({r["key"]: (r["at"], r["records"], 1 << 62 if r["file"].endswith(".gz") else r["size"]) for r in places})

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Part | None = None  # a part's lines come in order, to one task
        for batch in batches:
            for key, lines in stretches(batch):
                if own is None or own.key != key:
                    if own is not None:
                        yield from own.close(False)
                    own = _Part(key, *sent.value[key])
                yield from own.feed(lines)
        if own is not None:
            yield from own.close(False)

    files = spark.createDataFrame([(r["key"], r["file"], r["part"]) for r in places], "key long, file string, part long")
    pieces = part_lines(spark, path, "\n").mapInArrow(assembled, _PIECE).join(F.broadcast(files), "key").drop("key")
    cut = pieces.filter("not whole").groupBy("file", "record").agg(
        F.max("header").alias("header"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "sequence"))), lambda x: x["sequence"]), "").alias("sequence"),
        F.max("offset").alias("offset"),
        F.min(F.when(F.col("line_bases").isNotNull(), F.struct("part", "line_bases", "line_width"))).alias("line"),
    )
    columns = ("header", "sequence", "offset", "line_bases", "line_width", "file")
    every = pieces.filter("whole").select(*columns).union(cut.select("header", "sequence", "offset", "line.line_bases", "line.line_width", "file"))
    return every.select(F.regexp_extract("header", r"^\s*(\S*)", 1).alias("name"), *columns)


def write(records_: DataFrame, path: str, width: int = 60, line_end: str = "\n", by: tuple | None = None) -> None:
    """Records (name, note, sequence) as FASTA, lines of ``width`` bases.

    ``by``: a part number and an order; the records of a part make one file, in this order, in the folder ``part=...``.
    """
    head = F.concat(F.lit(">"), F.concat_ws(" ", "name", "note"))
    lines = F.regexp_replace("sequence", rf"(.{{{width}}})(?=.)", f"$1{line_end}")
    value = F.concat_ws(line_end, head, lines).alias("value")
    if by is None:
        records_.select(value).write.mode("overwrite").option("lineSep", line_end).text(path)
        return
    part, order = by
    rows = records_.select(value, part.alias("part") if isinstance(part, Column) else F.col(part).alias("part"), F.col(order).alias("at"))
    dealt = rows.repartition("part").sortWithinPartitions("part", "at")
    dealt.select("value", "part").write.mode("overwrite").partitionBy("part").option("lineSep", line_end).text(path)


def index_path(path: str) -> str:
    """Where the index of a FASTA file is written: its name without ``.gz``, and ``.fai``."""
    return path.removesuffix(".gz") + ".fai"


def index_paths(path: str) -> list[str]:
    """Where the index of a FASTA file may be: its name and ``.fai``, or ``.fai`` in place of its last ending."""
    folder, slash, name = path.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return list(dict.fromkeys([path + ".fai", folder + slash + stem + ".fai", index_path(path)]))


def find_index(spark: SparkSession, path: str) -> str | None:
    """The first of these that is there, on any store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for place in index_paths(path):
        there = jvm.org.apache.hadoop.fs.Path(place)
        if there.getFileSystem(conf).exists(there):
            return place
    return None


def write_index(entries: DataFrame, path: str) -> None:
    """Index rows as lines of five columns."""
    columns = ("name", "length", "offset", "line_bases", "line_width")
    entries.select(F.concat_ws("\t", *[F.col(c).cast("string") for c in columns]).alias("value")).write.mode("overwrite").text(path)


def index(records_: DataFrame, files: bool = False) -> DataFrame:
    """The index rows of FASTA records, with their file if asked for; empty sequences have none."""
    n = F.length("sequence").cast("long")
    return records_.filter(n > 0).select("name", n.alias("length"), "offset", "line_bases", "line_width", *(["file"] if files else []))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index's columns and ``corrupt``: the text of a line that isn't five columns, else null."""
    fields = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.length(F.trim("value")) > 0).select("value", fields.alias("x"))

    def number(i: int, kind: str):
        return F.get("x", F.lit(i)).try_cast(kind)

    numbers = [number(1, "long"), number(2, "long"), number(3, "int"), number(4, "int")]
    fine = F.size("x") >= 5
    for c in numbers:
        fine = fine & c.isNotNull()
    return rows.select(
        F.get("x", F.lit(0)).alias("name"),
        *[c.alias(n) for c, n in zip(numbers, ("length", "offset", "line_bases", "line_width"))],
        F.when(~fine, F.col("value")).alias("corrupt"),
    )


def index_issues(entries: DataFrame) -> DataFrame:
    """(rule, name, n): duplicate names, lengths that aren't positive, and lines narrower than their bases."""
    twice = entries.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate").alias("rule"), "name", "n")
    empty = entries.filter("length <= 0").select(F.lit("length").alias("rule"), "name", F.lit(1).cast("long").alias("n"))
    narrow = entries.filter("line_width <= line_bases").select(F.lit("line_width").alias("rule"), "name", F.lit(1).cast("long").alias("n"))
    return twice.union(empty).union(narrow)


def verify_index(entries: DataFrame, records_: DataFrame) -> DataFrame:
    """Index entries whose record is missing or has another length."""
    own = records_.select("name", F.length("sequence").cast("long").alias("found"))
    return entries.join(own, "name", "left").filter(F.col("found").isNull() | (F.col("found") != F.col("length"))).select("name", "length", "found")


def fetch(wanted: DataFrame, records_: DataFrame) -> DataFrame:
    """``wanted`` (with a ``name``) and the sequence of that name; null where no record has it."""
    return wanted.join(records_.select("name", "sequence"), "name", "left")


def transcripts(records_: DataFrame, low: int = 200, high: int = 5000) -> DataFrame:
    """Upper-case sequences of a length within bounds, anything but A, C, G, T made N."""
    clean = F.regexp_replace(F.upper("sequence"), "[^ACGT]", "N")
    return records_.select("name", clean.alias("sequence")).filter(F.length("sequence").between(low, high))
