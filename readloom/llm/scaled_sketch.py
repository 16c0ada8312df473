"""Document fingerprints (operator 7): threshold-scaled sketches.

A sketch keeps every shingle hash below one fixed fraction of the hash space, for all texts alike, so its size follows
the document's, and sketches of very unequal documents still estimate how much of the smaller one the larger one holds.
Sketches merge by union, and what is in both of two sketches is in the sketch of the intersection: no sketch needs to know
how another one was made. Shingles are stretches of bytes, one at each byte, so that short texts have enough of them for a
fraction to be left; they are hashed as arrays, many texts at once.

``neighbours`` pairs each document with the next one in descending id order. Texts are shuffled once,
into buckets of the composite order (id, text hash); the bucket borders are rows' own keys, and the
first row of a bucket is also sent to the end of the bucket before it, so no bucket ever waits for
another and a bucket is read as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import slices

#: Bytes of a shingle, a multiple of 8.
SHINGLE = 16
#: The share of the hash space that is kept, as 1 / SCALE. A hash has ``BITS`` bits, shown as ``BITS`` / 4 hexadecimal digits.
SCALE, BITS = 4, 48
#: Bytes of text that are hashed at once.
BATCH = 4 << 20
#: Rows whose keys are looked at to choose bucket borders, and buckets, at most.
BORDER_ROWS, BUCKETS = 200_000, 20_000


def _odd(i: int) -> np.uint64:
    """The i-th of the odd multipliers: digits of a hash of its number."""
    return np.uint64(int.from_bytes(hashlib.sha256(f"multiplier {i}".encode()).digest()[:8], "little") | 1)


def hashes_of(data: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """A hash of ``BITS`` bits of the k bytes at each place: a sum of products of 8-byte words, mixed by shifts and products."""
    n = len(data) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(0, k, 8):
        words = np.ndarray((n,), "<u8", data.data, offset=i, strides=(1,))  # overlapping words, one at each byte
        out += words * _odd(i // 8)
    for shift, i in ((33, 100), (29, 101)):
        out ^= out >> np.uint64(shift)
        out *= _odd(i)
    out ^= out >> np.uint64(32)
    return out >> np.uint64(64 - BITS)


def normal(text: str | None) -> bytes:
    """A text's words (runs of anything but ASCII white space) with A-Z lower-cased, joined by one space."""
    return b" ".join((text or "").encode().lower().split())


def sketches_of(texts: list[str | None], scale: int = SCALE, k: int = SHINGLE) -> list[np.ndarray]:
    """Of each text the sorted distinct shingle hashes below 1 / scale of the hash space.

    A text of fewer than k bytes, but not none, is one shingle, filled up with zeros.
    """
    parts = [normal(t) for t in texts]
    sizes = np.fromiter((max(len(p), k) if p else 0 for p in parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(p if len(p) >= k or not p else p.ljust(k, b"\0") for p in parts), np.uint8)
    hashes = hashes_of(data, k)
    at = np.flatnonzero(hashes < np.uint64((1 << BITS) // scale))
    ends = np.cumsum(sizes)
    own = np.searchsorted(ends, at, side="right")
    within = at + k <= ends[own] if len(at) else np.empty(0, bool)  # no shingle goes on over a text's end
    at, own = at[within], own[within]
    found = hashes[at]
    order = np.lexsort((found, own))
    found, own = found[order], own[order]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:] != found[:-1]) | (own[1:] != own[:-1])
    return np.split(found[first], np.searchsorted(own[first], np.arange(1, len(parts)))) if parts else []


def likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, int]:
    """Estimated share of the smaller one's shingles that the larger one has, and the hashes it rests on.

    Where one has no hash nothing is known: 1 for two empty sketches, else 0.
    """
    n = min(len(a), len(b))
    if not n:
        return float(len(a) == len(b)), 0
    return len(np.intersect1d(a, b, assume_unique=True)) / n, n


def as_text(sketch: np.ndarray) -> str:
    """``BITS`` / 4 hexadecimal digits a hash, in ascending order."""
    octets = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)
    return octets[:, 8 - BITS // 8 :].tobytes().hex()


def listed(sketch: np.ndarray) -> list[str]:
    every, n = as_text(sketch), BITS // 4
    return [every[i : i + n] for i in range(0, len(every), n)]


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, k: int = SHINGLE) -> DataFrame:
    """(id, sketch): each row's kept hashes as sorted hexadecimal strings. No shuffle.

    Null, empty and blank texts have an empty sketch. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            found = [listed(x) for x in sketches_of(batch.column("text").to_pylist(), scale, k)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.string()))], ["id", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, sketch array<string>").withColumnRenamed("id", id_col)


def merged(sketches_: DataFrame, by: str) -> DataFrame:
    """(group, sketch): the union of its documents' sketches. Hashes are made distinct before they meet."""
    flat = sketches_.select(by, F.explode_outer("sketch").alias("h")).distinct()
    return flat.groupBy(by).agg(F.sort_array(F.collect_list("h")).alias("sketch"))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, of two sketch columns of one scale; null if a has none."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(a))


def _borders(keys: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """First keys of about ``buckets`` even ranges, in order, from at most ``BORDER_ROWS`` rows' keys.

    The number of rows decides how many of them are drawn, by a hash of their keys, so what reaches the driver
    doesn't grow with the table.
    """
    n, least = keys.agg(F.count("*"), F.min(F.struct("k", "h"))).first()
    share = min(1.0, BORDER_ROWS / 2 / max(1, n))
    drawn = keys.filter(F.pmod(F.xxhash64("k", "h"), F.lit(1 << 30)) <= int(share * (1 << 30)))
    drawn = drawn.distinct().limit(BORDER_ROWS).collect()  # twice the rows that are expected: the limit is never met
    drawn = sorted({*((r["k"], r["h"]) for r in drawn), *([tuple(least)] if n else [])})
    firsts = drawn[:: max(1, -(-len(drawn) // min(buckets, BUCKETS)))]
    return np.array([k for k, _ in firsts], np.int64), np.array([h for _, h in firsts], np.int64)


def bucket_of(k: np.ndarray, h: np.ndarray, fk: np.ndarray, fh: np.ndarray) -> np.ndarray:
    """The last range whose first key isn't above (k, h)."""
    low, high = np.searchsorted(fk, k, "left"), np.searchsorted(fk, k, "right")
    out = high - 1
    for i in np.flatnonzero(high > low).tolist():
        out[i] = low[i] + np.searchsorted(fh[low[i] : high[i]], h[i], "right") - 1
    return out


def neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scale: int = SCALE, k: int = SHINGLE) -> DataFrame:
    """Each document's sketch beside that of its edited text and of the next document's text.

    The next document is the one with the next lower id (rows with one id follow by a hash of their
    text; null ids come last); after the last comes the first, so a single row is its own next. The
    edited text is the text with its last floor(n/3) code points replaced by the first as many (or
    all) of the next one's. Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (see ``likeness``), and known_edited and known_next, the hashes that they rest
    on: where it is 0 nothing is known, and the likeness is 1 for two empty sketches, else 0. Null texts count
    as empty; an empty table gives no rows; other columns are ignored. Rows that are equal in id and text
    are read as one stream, in bounded memory, but in one task.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    # ascending k is descending id, nulls last (~id doesn't overflow)
    order = F.coalesce(F.bitwise_not("id"), F.lit((1 << 63) - 1)).alias("k")
    rows = rows.select("id", order, F.xxhash64("text").alias("h"), "text")
    buckets = 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fk, fh = _borders(rows.select("k", "h"), buckets)
    last = len(fk) - 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            keys, hashes = batch.column("k").to_numpy(), batch.column("h").to_numpy()
            bucket = bucket_of(keys, hashes, fk, fh)
            first = (keys == fk[bucket]) & (hashes == fh[bucket])
            for part, at, seam in (
                (batch, bucket, False),
                (batch.filter(pa.array(first)), np.where(bucket[first] > 0, bucket[first] - 1, last), True),
            ):
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(at.astype(np.int32)), pa.array(np.full(len(at), seam))],
                    [*part.schema.names, "bucket", "seam"],
                )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int | None, str] | None = None
        for batch in slices(batches, "text", BATCH):
            texts = [held[1] if held else ""]  # each text once, after the one that waits for its next
            paired: list[tuple[int | None, int, int]] = []  # id, own text, next text
            waiting = (held[0], 0) if held else None
            for id_, text, seam in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "seam"))):
                if waiting is None and seam:
                    continue  # a copy of the seam row that ended this bucket
                texts.append(text)
                if waiting is not None:
                    paired.append((*waiting, len(texts) - 1))
                waiting = None if seam else (id_, len(texts) - 1)
            held = (waiting[0], texts[waiting[1]]) if waiting else None
            if paired:
                yield _rows(texts, paired, scale, k)

    dealt = rows.mapInArrow(deal, "id long, k long, h long, text string, bucket int, seam boolean")
    streams = dealt.repartition("bucket").sortWithinPartitions("bucket", "seam", "k", "h", "text")
    found = streams.mapInArrow(
        compare,
        "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, known_edited long, known_next long",
    )
    return found.withColumnRenamed("id", id_col)


def _rows(texts: list[str], paired: list[tuple[int | None, int, int]], scale: int, k: int) -> pa.RecordBatch:
    own = sketches_of(texts, scale, k)
    cuts = [(texts[i], texts[j], len(texts[i]) // 3) for _, i, j in paired]
    edited = [text[: len(text) - cut] + after[:cut] for text, after, cut in cuts]
    changed = sketches_of(edited, scale, k)
    near_edited = [likeness(own[i], c) for (_, i, _), c in zip(paired, changed)]
    near_next = [likeness(own[i], own[j]) for _, i, j in paired]
    columns = {
        "id": pa.array([id_ for id_, _, _ in paired], pa.int64()),
        "n_chars": pa.array([len(texts[i]) for _, i, _ in paired], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
        "fingerprint": pa.array([as_text(own[i]) for _, i, _ in paired]),
        "edited_fingerprint": pa.array([as_text(c) for c in changed]),
        "near_edited": pa.array([x for x, _ in near_edited], pa.float64()),
        "near_next": pa.array([x for x, _ in near_next], pa.float64()),
        "known_edited": pa.array([n for _, n in near_edited], pa.int64()),
        "known_next": pa.array([n for _, n in near_next], pa.int64()),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
