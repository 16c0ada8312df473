"""Sequences of an indexed FASTA file by name: only the bytes of the wanted ones are read.

An index entry says where a sequence's bytes are. The entries of the wanted names are sorted by file and place, neighbours are merged to
ranges, and each range is one read. ``FastaRanges`` is a data source that plans this from a filter on the name; ``fetch_ranges``
does the same for names that are a table of any size. Both open files through Arrow's file systems (local, HDFS, object stores).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Ranges so near to each other are read as one; a range ends at so many bytes, unless it is one sequence; bytes of a task.
GAP, RANGE, TASK = 1 << 16, 8 << 20, 64 << 20
SCHEMA = "name string, sequence string, bytes long"
_KINDS = (pa.string(), pa.string(), pa.int64())


@dataclass(frozen=True)
class Entry:
    name: str
    length: int
    offset: int
    line_bases: int
    line_width: int

    @property
    def end(self) -> int:
        """The byte after the last base: whole lines with their line ends, and the bases of the last one."""
        if self.length <= 0 or self.line_bases <= 0:
            return self.offset
        lines, rest = divmod(self.length - 1, self.line_bases)
        return self.offset + lines * self.line_width + rest + 1


def merged(entries: Iterable[Entry], gap: int = GAP, most: int = RANGE) -> Iterator[list[Entry]]:
    """Entries in order of their place, as lists that are read at once."""
    held: list[Entry] = []
    end = 0
    for e in sorted(entries, key=lambda e: (e.offset, e.end)):
        if held and (e.offset > end + gap or e.end > held[0].offset + most):
            yield held
            held = []
        held.append(e)
        end = max(end, e.end) if len(held) > 1 else e.end
    if held:
        yield held


def opened(path: str) -> pa.NativeFile:
    if path.startswith("file:"):
        path = unquote(path.removeprefix("file://").removeprefix("file:"))
    if "://" in path:
        system, place = pafs.FileSystem.from_uri(path)
    else:
        system, place = pafs.LocalFileSystem(), path
    return system.open_input_file(place)


def read_ranges(file: pa.NativeFile, ranges: Iterable[list[Entry]]) -> Iterator[tuple[Entry, str]]:
    for part in ranges:
        start = part[0].offset
        data = file.read_at(max(e.end for e in part) - start, start)
        for e in part:
            raw = data[e.offset - start : e.end - start]
            yield e, raw.replace(b"\n", b"").replace(b"\r", b"").decode("ascii", "replace")


class Ranges(InputPartition):
    def __init__(self, path: str, ranges: list[list[Entry]]):
        self.path, self.ranges = path, ranges

    @property
    def bytes(self) -> int:
        return sum(max(e.end for e in r) - r[0].offset for r in self.ranges)


class FastaRanges(DataSource):
    """``spark.read.format("fasta_ranges").option("index", fai).load(fasta).filter(name in ...)``: sequences of an uncompressed file.

    A filter that the name is one of given values chooses what is read (``spark.sql.python.filterPushdown.enabled``); without one all entries
    are. Option ``gap``: bytes that may be read needlessly between two sequences. Entries of a name that comes twice are all read.
    """

    @classmethod
    def name(cls) -> str:
        return "fasta_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(self.options)


class RangeReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        if self.path.endswith(".gz"):
            raise ValueError("a compressed file has no places to read from; use read_split and fetch")
        self.index = options.get("index", self.path + ".fai")
        self.gap = int(options.get("gap", GAP))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self._want({f.value})
            elif isinstance(f, In) and f.attribute == ("name",):
                self._want(set(f.value))
            else:
                yield f

    def _want(self, names: set) -> None:
        self.wanted = names if self.wanted is None else self.wanted & names

    def entries(self) -> Iterator[Entry]:
        with opened(self.index) as file:
            for line in file.read().decode().splitlines():
                fields = line.split("\t")
                try:
                    entry = Entry(fields[0], *map(int, fields[1:5]))
                except (TypeError, ValueError):
                    continue  # a corrupt line
                if self.wanted is None or entry.name in self.wanted:
                    yield entry

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for part in merged(self.entries(), self.gap):
            held.append(part)
            size += max(e.end for e in part) - part[0].offset
            if size >= TASK:
                out.append(Ranges(self.path, held))
                held, size = [], 0
        if held or not out:
            out.append(Ranges(self.path, held))
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        if not partition.ranges:
            return
        with opened(partition.path) as file:
            for part in partition.ranges:
                rows = [(e.name, text, e.end - e.offset) for e, text in read_ranges(file, [part])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], ["name", "sequence", "bytes"])


def fetch_ranges(wanted: DataFrame, entries: DataFrame, gap: int = GAP) -> DataFrame:
    """``wanted`` (with a ``name``) and the sequence of that name; null where no entry has it, or only an empty one.

    ``entries``: name, length, offset, line_bases, line_width and file, as ``fasta.read_split`` and ``fasta.index`` give them. Names are made
    distinct and joined with the index, not with the sequences; entries are dealt by ranges of (file, offset), so a task reads
    neighbours, and merges them. Of entries with one name all are given. Nothing of it passes through the driver.
    """
    names = wanted.select("name").filter("name is not null").distinct()
    hits = entries.join(names, "name", "left_semi").select("file", "name", "length", "offset", "line_bases", "line_width")
    hits = hits.filter("length > 0 and line_bases > 0")
    dealt = hits.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_file: dict[str, list[Entry]] = {}
            for file, *rest in zip(*(batch.column(c).to_pylist() for c in ("file", "name", "length", "offset", "line_bases", "line_width"))):
                by_file.setdefault(file, []).append(Entry(*rest))
            for path, own in by_file.items():
                with opened(path) as file:
                    for part in merged(own, gap):
                        rows = [(e.name, text, e.end - e.offset) for e, text in read_ranges(file, [part])]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], ["name", "sequence", "bytes"])

    found = dealt.mapInArrow(run, SCHEMA)
    return wanted.join(found.select("name", F.col("sequence")), "name", "left")
