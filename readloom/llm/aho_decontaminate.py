"""Benchmark decontamination (operator 4): one Aho-Corasick automaton over benchmark windows.

Windows of consecutive item words become patterns of one automaton; each document is scanned once,
on its normalised words, and matches are mapped back to word positions and to byte offsets of the
original text. Documents are never shuffled nor written. The benchmark's windows are sent to every
task, within ``WINDOW_BYTES`` (a larger benchmark is refused). One automaton holds up to ``AUTOMATON_BYTES`` of
them; of more, each task builds one after another and lets a stretch of its texts pass each of them, so
the corpus is still read once and a task holds one automaton at a time.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import WORD_BYTES, as_bytes, slices, written

WINDOW = 10
#: Bytes of distinct patterns in one automaton; about 35 bytes of memory each.
AUTOMATON_BYTES = 8 << 20
#: Bytes of all patterns and of their lists of items (8 an entry), which the driver and every task hold.
WINDOW_BYTES = 256 << 20
#: Bytes of text that pass one automaton before the next is built, where there are several.
STRETCH = 128 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def _windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(pattern, items): distinct windows, with the ids (as strings, null: empty) of their items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, patterns = [], []
            for item, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = words_of(text)
                for i in range(max(1, len(words) - window + 1) if words else 0):
                    items.append(item or "")
                    patterns.append(b" ".join(words[i : i + window]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(patterns, pa.binary())], ["item", "pattern"])

    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(run, "item string, pattern binary")
    return rows.distinct()


def sent_windows(windows: DataFrame, most: int = WINDOW_BYTES) -> tuple[list[bytes], list[list[int]], list[str]]:
    """Distinct patterns, the items of each as places in the list of items, and that list, sorted; sizes are checked first."""
    sums = windows.groupBy("pattern").agg(F.count("*").alias("n"))
    size = sums.agg(F.sum(F.octet_length("pattern") + 8 * F.col("n"))).first()[0] or 0
    size += windows.select("item").distinct().agg(F.sum(F.octet_length("item"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the benchmark's windows take {size} bytes; {most} may be sent to every task. Scan with parts of the benchmark")
    names = sorted(r[0] for r in windows.select("item").distinct().collect())
    place = {name: i for i, name in enumerate(names)}
    listed = windows.groupBy("pattern").agg(F.collect_list("item")).collect()
    return [bytes(r[0]) for r in listed], [[place[x] for x in r[1]] for r in listed], names


class _Scanner:
    """Automata over parts of the patterns; a Python worker keeps the one that it built last."""

    kept: dict[tuple[str, int], ahocorasick.Automaton] = {}

    def __init__(self, patterns: list[bytes], items: list[list[int]], names: list[str], key: str, automaton_bytes: int):
        self.patterns, self.items, self.names, self.key = patterns, items, names, key
        ends = np.cumsum([0, *map(len, patterns)])
        self.parts = max(1, -(-int(ends[-1]) // automaton_bytes))
        self.of = np.minimum(ends[:-1] // max(1, automaton_bytes), self.parts - 1)

    def automaton(self, part: int) -> ahocorasick.Automaton:
        if (self.key, part) not in self.kept:
            self.kept.clear()
            built = ahocorasick.Automaton()
            for i in np.flatnonzero(self.of == part).tolist():
                # one character for each byte; spaces on both sides keep matches to whole words
                pattern = self.patterns[i]
                built.add_word(f" {pattern.decode('latin-1')} ", (pattern.count(b" ") + 1, i))
            built.make_automaton()
            self.kept[self.key, part] = built
        return self.kept[self.key, part]

    def scan_all(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int, int, int]], list[str]]]:
        """Of each text its words, merged hit spans (first word, word after, first byte, byte after), and items that occur."""
        joined = [b" ".join(words_of(t)).decode("latin-1") for t in texts]
        found: list[set] = [set() for _ in texts]
        for part in range(self.parts if self.patterns else 0):
            automaton = self.automaton(part)
            for words, hits in zip(joined, found):
                hits.update((end, i) for end, (_, i) in automaton.iter(f" {words} "))
        return [self.placed(text, words, hits) for text, words, hits in zip(texts, joined, found)]

    def placed(self, text: bytes | None, joined: str, hits: set[tuple[int, int]]) -> tuple[int, list[tuple[int, int, int, int]], list[str]]:
        if not hits:
            return joined.count(" ") + bool(joined), [], []
        words = joined.split(" ")
        found = sorted(hits)
        last = np.cumsum([len(w) + 1 for w in words])  # where the space after each word stands
        at = np.searchsorted(last, [end for end, _ in found]).tolist()
        spans = sorted({(e - self.patterns[i].count(b" "), e + 1) for e, (_, i) in zip(at, found)})
        merged = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        octets = np.frombuffer(text.translate(WORD_BYTES), np.uint8) != 32
        edges = np.diff(np.concatenate([[0], octets.view(np.int8), [0]]))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        items = sorted({x for i in {i for _, i in found} for x in self.items[i]})
        return len(words), [(a, b, int(starts[a]), int(ends[b - 1])) for a, b in merged], [self.names[x] for x in items]


_SPAN = pa.struct([("first", pa.int32()), ("after", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])


def scan(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    automaton_bytes: int = AUTOMATON_BYTES,
    prefix: str = "",
) -> DataFrame:
    """``docs`` and three columns: n_words, spans and items, their names after ``prefix``.

    spans: merged stretches of words within benchmark windows, as word numbers [first, after) and byte
    offsets [start, end) of the original text; items: sorted ids (as strings) of the items with a
    window in the text. Columns of ``docs`` with these three names give way. Null and empty texts
    have no words and no spans; items without words have no windows; repeated items count once; an
    item without an id is the item ''. Empty documents or an empty benchmark give no spans. Rows
    keep their number and order within partitions.
    """
    new = [prefix + c for c in ("n_words", "spans", "items")]
    docs = docs.drop(*new)
    windows = written(_windows(benchmark, item_col, item_text_col, window), "windows")
    patterns, items, names = sent_windows(windows)
    sent = docs.sparkSession.sparkContext.broadcast(_Scanner(patterns, items, names, uuid.uuid4().hex, automaton_bytes))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = sent.value
        cut = slices(batches, text_col, 16 << 20)
        for part in _stretches(cut, text_col, STRETCH if scanner.parts > 1 else 1):
            found = scanner.scan_all([t for batch in part for t in as_bytes(batch.column(at))])
            done = 0
            for batch in part:
                own = found[done : done + batch.num_rows]
                done += batch.num_rows
                columns = [
                    pa.array([x[0] for x in own], pa.int64()),
                    pa.array([[dict(zip(("first", "after", "start", "end"), s)) for s in x[1]] for x in own], pa.list_(_SPAN)),
                    pa.array([x[2] for x in own], pa.list_(pa.string())),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    hits = f"`{new[0]}` long, `{new[1]}` array<struct<first:int,after:int,start:long,end:long>>, `{new[2]}` array<string>"
    return docs.mapInArrow(run, f"{fields}, {hits}")


def _stretches(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches brought together until ``column`` holds ``most`` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(column).nbytes
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns to compare by: counts, a digest of the items, whether anything is hit, and the spans as text.

    A span is first:after:start:end, words and bytes of the original text; spans are comma-joined.
    """
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["after"] - s["first"])
    return scanned.select(
        id_col,
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["first"], s["after"], s["start"], s["end"])), ",").alias("spans"),
    )


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
