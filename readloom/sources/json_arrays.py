"""JSON files that are one array, split among tasks whatever their layout: bare or within an object, indented or one line.

Files are read in parts that end at closing braces. Where an array's elements start and end depends on all text before: whether
a string is open, and how many brackets are. A part's effect on this state is summed up for both ways that it may start (within a
string or not): how the string ends, by how much the depth changes, and the least depth on the way. Such sums join in order, a few
numbers a part, so each part gets to know the state that it starts in and cuts its elements by itself; what a border cuts is
brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.sources.files import part_lines, part_table, stretches

#: Parts whose sums may be held by the driver and sent to every task (some 200 bytes each).
MOST_PARTS = 500_000
_QUOTE, _SLASH, _OPEN, _CLOSE = 34, 92, 123, 125
_STEP = np.zeros(256, np.int8)
_STEP[[91, 123]], _STEP[[93, 125]] = 1, -1
#: What may stand between elements: white space, commas and brackets.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[list(b" \t\r\n,{}[]")] = True


def _quotes(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, bool]:
    """Which bytes are quotes that open or close a string, and whether the byte after the last one is escaped."""
    slash = data == _SLASH
    at = np.arange(len(data))
    # the length of the run of backslashes that ends at each byte
    last_other = np.maximum.accumulate(np.where(slash, -1, at))
    run = np.where(slash, at - last_other, 0)
    first = last_other < 0
    run[first & slash] = at[first & slash] + 1 + escaped
    before = np.concatenate([[int(escaped)], run[:-1]])
    return (data == _QUOTE) & (before % 2 == 0), bool(run[-1] % 2) if len(run) else escaped


class _State:
    """Whether a string is open, and the depth, along a part's bytes."""

    def __init__(self, inside: bool, depth: int):
        self.inside, self.depth, self.escaped = inside, depth, False

    def read(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each byte: whether it belongs to a string, its step of the depth, and the depth after it."""
        quotes, self.escaped = _quotes(data, self.escaped)
        count = np.cumsum(quotes) + self.inside
        inside = (count % 2 == 1) | quotes
        step = np.where(inside, 0, _STEP[data])
        depth = self.depth + np.cumsum(step, dtype=np.int64)
        if len(data):
            self.inside, self.depth = bool(count[-1] % 2), int(depth[-1])
        return inside, step, depth


@dataclass
class _Sum:
    """A part that starts in a string or not: the change of depth, the least depth, and where the array's key may stand."""

    inside: bool
    delta: int = 0
    least: int = 0
    keys: list[list[int]] = field(default_factory=list)  # depth at the key, least depth after its bracket


def _summed(states: list[_State], sums: list[_Sum], data: bytes, key: re.Pattern) -> None:
    octets = np.frombuffer(data, np.uint8)
    found = [(m.start(), m.end()) for m in key.finditer(data)]
    for state, own in zip(states, sums):
        started = state.depth
        inside, _, depth = state.read(octets)
        least = np.minimum.accumulate(depth[::-1])[::-1]
        own.least = min(own.least, int(least[0]))
        for k in own.keys:
            k[1] = min(k[1], int(least[0]))
        for a, b in found:
            # a key's quote opens a string: no string is open before it
            if not (inside[a - 1] and octets[a - 1] != _QUOTE if a else state is not states[0]) and inside[a] and not inside[b - 1]:
                own.keys.append([int(depth[a - 1]) if a else started, int(least[b - 1])])
        own.delta = state.depth


_PARTS = "key long, head string, parity boolean, deltas array<long>, leasts array<long>, keys array<array<array<long>>>"


def _bytes(lines: pa.Array) -> bytes:
    """The text of a part's lines, with the braces that parted them; one more at the end of a file does no harm."""
    return b"}".join([*lines.cast(pa.binary()).to_pylist(), b""])


def _summaries(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    pattern = re.compile(rb'"' + re.escape(key) + rb'"\s*:\s*\[')

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, states, sums, head = None, [], [], ""

        def done() -> pa.RecordBatch:
            row = [[own], [head], [states[0].inside], [[s.delta for s in sums]], [[s.least for s in sums]], [[s.keys for s in sums]]]
            kinds = [pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.list_(pa.list_(pa.int64())))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], [c.split()[0] for c in _PARTS.split(", ")])

        for batch in batches:
            for key_, lines in stretches(batch):
                if own != key_:
                    if own is not None:
                        yield done()
                    own, head, states, sums = key_, "", [_State(False, 0), _State(True, 0)], [_Sum(False), _Sum(True)]
                data = _bytes(lines)
                head = head or data.lstrip(b"\xef\xbb\xbf \t\r\n")[:1].decode("latin-1")
                _summed(states, sums, data, pattern)
        if own is not None:
            yield done()

    places = part_table(spark, path, line_end="}").select("key", "file", "part")
    return part_lines(spark, path, "}").mapInArrow(run, _PARTS).join(places, "key")


def _starts(parts: list, level: dict[str, int]) -> dict[int, tuple[tuple[bool, int, int, bool], int, str, int]]:
    """(start, level, file, part) of each part; start is the state that it starts in: a string open, the depth, the part that an open element started in, and whether in the array."""
    out, last = {}, None
    for r in sorted(parts, key=lambda r: (r["file"], r["part"])):
        if last is None or last[0] != r["file"]:
            _ended(last)
            last = [r["file"], False, 0, r["part"], level[r["file"]] == 1]
        file, inside, depth, opened, reading = last
        out[r["key"]] = ((inside, depth, opened, reading), level[file], file, r["part"])
        low = depth + r["leasts"][inside]
        if level[file] == 2:
            reading = reading and low > 1
            for at, least in r["keys"][inside]:
                if depth + at == 1:
                    reading = depth + least > 1
        if low <= level[file]:
            opened = r["part"]
        last = [file, inside != r["parity"], depth + r["deltas"][inside], opened, reading]
    _ended(last)
    return out


def _ended(last: list | None) -> None:
    if last is not None and (last[1] or last[2] > 0):
        raise ValueError(f"{last[0]} ends within its array")


class _Cutter:
    """Cuts the elements out of one part's text."""

    def __init__(self, start: tuple[bool, int, int, bool], level: int, key: re.Pattern, file: str):
        inside, depth, self.opened, self.reading = start
        self.state, self.level, self.key, self.file = _State(inside, depth), level, key, file
        self.held: list[bytes] | None = [] if depth > level and self.reading else None
        self.cut = self.held is not None  # the open element started in another part

    def feed(self, data: bytes) -> Iterator[tuple[bool, bytes]]:
        """(whole, text) of the elements that end here; of one that another part started, what is here of it."""
        octets = np.frombuffer(data, np.uint8)
        inside, step, depth = self.state.read(octets)
        if self.level == 1:
            reading = np.ones(len(octets), bool)
        else:
            # from the bracket after the key on, as long as the depth stays above 1
            marks = np.full(len(octets), -1, np.int8)
            marks[depth <= 1] = 0
            for m in self.key.finditer(data):
                if inside[m.start()] and not inside[m.end() - 1] and depth[m.end() - 1] == 2:
                    marks[m.end() - 1] = 1
            at = np.maximum.accumulate(np.where(marks >= 0, np.arange(len(octets)), -1))
            reading = np.where(at >= 0, marks[at] == 1, self.reading)
            self.reading = bool(reading[-1]) if len(reading) else self.reading
        odd = reading & (depth == self.level) & ~_BETWEEN[octets] & (step == 0)
        if odd.any():
            raise ValueError(f"{self.file}: an element that is no object: {data[int(np.argmax(odd)) :][:40]!r}")
        starts = np.flatnonzero(reading & (octets == _OPEN) & (step == 1) & (depth == self.level + 1)).tolist()
        ends = np.flatnonzero(reading & (octets == _CLOSE) & (step == -1) & (depth == self.level)).tolist()
        if self.held is not None:
            if not ends:
                self.held.append(data)
                return
            yield not self.cut, b"".join([*self.held, data[: ends[0] + 1]])
            self.held, self.cut, ends = None, False, ends[1:]
        for a, b in zip(starts, ends):
            yield True, data[a : b + 1]
        if len(starts) > len(ends):
            self.held = [data[starts[-1] :]]


def elements(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """(file, value): the text of every object of the array that each file is, or that its top object has under ``key``.

    Files may be laid out in any way, compressed, and of any size; a compressed one is read by one task. Files without text
    have no elements. Refused are files that end within their array, arrays with elements that aren't objects, and files
    that start with neither a bracket nor, if ``key`` is given, a brace.
    """
    parts = _summaries(spark, path, (key or "").encode()).limit(MOST_PARTS + 1).collect()
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts of files; read them in several calls")
    heads = {r["file"]: r["head"] for r in sorted(parts, key=lambda r: -r["part"])}  # each file's first part comes last
    level = {file: 1 if h == "[" else 2 for file, h in heads.items()}
    for file, h in heads.items():
        if h not in ("", "}", "[") and (h != "{" or key is None):
            raise ValueError(f"{file} is not an array")
    sent = spark.sparkContext.broadcast(_starts(parts, level))
    pattern = re.compile(rb'"' + re.escape((key or "").encode()) + rb'"\s*:\s*\[')

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, part = None, None, 0

        def rows(found: list[tuple[bool, bytes]], opened: int) -> pa.RecordBatch:
            n = len(found)
            whole, texts = zip(*found)
            columns = [pa.array([at] * n, pa.int64()), pa.array([opened] * n, pa.int64()), pa.array(whole, pa.bool_()), pa.array(texts, pa.binary()).cast(pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["key", "opened", "whole", "value"])

        def rest() -> Iterator[pa.RecordBatch]:
            if own is not None and own.held is not None:
                yield rows([(False, b"".join(own.held))], own.opened if own.cut else part)

        for batch in batches:
            for key_, lines in stretches(batch):
                if at != key_:
                    yield from rest()
                    start, level_, file, part = sent.value[key_]
                    at, own = key_, _Cutter(start, level_, pattern, file)
                opened = own.opened
                if found := list(own.feed(_bytes(lines))):
                    yield rows(found, opened)
        yield from rest()

    files = spark.createDataFrame([(r["key"], r["file"], r["part"]) for r in parts], "key long, file string, part long")
    found = part_lines(spark, path, "}").mapInArrow(cut, "key long, opened long, whole boolean, value string").join(F.broadcast(files), "key")
    pieces = found.filter("not whole").groupBy("file", "opened").agg(F.sort_array(F.collect_list(F.struct("part", "value"))).alias("x"))
    joined = pieces.select("file", F.array_join(F.transform("x", lambda p: p["value"]), "").alias("value"))
    return found.filter("whole").select("file", "value").union(joined)
