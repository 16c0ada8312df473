"""Sharding (operator 13): histogram sort. Shards are ranges of keys of near equal bytes.

1. A row's key is the digest of its text and that of its id, so equal texts lie side by side in the order of keys and share a
   shard unless a border falls among them. Keys and sizes are written once; texts aren't needed after that.
2. Borders are sought among probes, 4096 to a cell: all rows' bytes are counted by the first digits of their keys, and the
   exact bytes below each probe tell in which cell each border lies. Only cells with a border go on to the next round, with
   new probes that start where the keys of the cell begin to differ (so a large group of equal texts takes one round,
   whatever its size). A border is met when its cell is one row: the row at which the bytes below reach the shard's share.
3. Rows go to their places in one exchange. A shard is cut into pieces of about ``PIECE`` rows by its rows' digests; pieces are
   numbered apart and their counts added up, so no task holds a shard.

Only DataFrame functions are used. The driver holds a sum for each probe of a cell with a border.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import written

SHARDS = 24
#: Bytes that a row takes besides its text.
ROW_BYTES = 8
#: Hexadecimal digits of a round's probes, and of a key: text's digest, id's digest, the row's number.
DIGITS, KEY = 3, 80
#: Above every key.
PAST = "g"
#: Rows that are numbered together, about.
PIECE = 8_192
#: Borders and probes are literals of the plan and rows of the driver.
MOST_SHARDS = 1_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, text_crc32, key, carried) of every row; rows alike in text and id are told apart by their number."""
    text = F.coalesce(F.col(text_col).cast("binary"), F.lit(b"").cast("binary"))
    id_ = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    number = F.lower(F.lpad(F.hex(F.monotonically_increasing_id()), KEY - 64, "0"))
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(F.md5(text), F.md5(id_.cast("binary")), number).alias("key"),
        F.struct(*[F.col(c) for c in carry], F.lit(0).alias("_")).alias("carried"),
    )


def _counted(rows: DataFrame, depth: dict[str, int]) -> dict[str, list[tuple[str, str, int]]]:
    """For each cell (a start of keys) its probes in order: first and last key and bytes of the rows with one more start of ``depth`` digits."""
    probe = F.coalesce(*[F.when(F.startswith("key", F.lit(cell)), F.left("key", F.lit(n))) for cell, n in depth.items()])
    found = rows.select(probe.alias("probe"), "key", "size").filter("probe is not null").groupBy("probe")
    out: dict[str, list] = {cell: [] for cell in depth}
    lengths = sorted({len(cell) for cell in depth})
    for r in found.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.sum("size").alias("size")).collect():
        cell = next(r["low"][:n] for n in lengths if r["low"][:n] in depth)
        out[cell].append((r["low"], r["high"], r["size"]))
    return {cell: sorted(probes) for cell, probes in out.items()}


def borders(rows: DataFrame, shards: int) -> list[str]:
    """First keys of shards 1, 2, ...: border k is the first row with k / shards of all bytes or more before it.

    Exact, so a row's shard is the whole part of shards x bytes before it / all bytes. Past the last key: a
    start that is above all keys.
    """
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    first = dict.fromkeys(range(1, shards), PAST)
    # borders by the cell that they lie in, each with the first key after the cell; bytes before the cell
    cells: dict[str, tuple[int, list[tuple[int, str]]]] = {"": (0, [(k, PAST) for k in first])} if total and shards > 1 else {}
    digits = DIGITS
    while cells:
        probes = _counted(rows, {cell: len(cell) + digits for cell in cells})
        following: dict[str, tuple[int, list[tuple[int, str]]]] = {}
        for cell, (before, waiting) in cells.items():
            lows, ends = [p[0] for p in probes[cell]], list(accumulate((p[2] for p in probes[cell]), initial=before))
            for k, beyond in waiting:
                # the first probe with bytes above the border's share
                j = bisect_right(ends, k * total // shards, lo=1) - 1
                after = lows[j + 1] if j + 1 < len(lows) else beyond
                if j == len(lows):
                    first[k] = beyond
                elif ends[j] * shards >= k * total:
                    first[k] = lows[j]
                elif lows[j] == probes[cell][j][1]:
                    first[k] = after
                else:
                    shared = commonprefix([lows[j], probes[cell][j][1]])
                    following.setdefault(shared, (ends[j], []))[1].append((k, after))
        cells, digits = following, DIGITS if shards <= 64 else DIGITS - 1
    return [first[k] for k in sorted(first)]


def _place(key: Column, first: list[str], low: int = 0) -> Column:
    """The number of borders at or below a key: a tree of comparisons."""
    if not first:
        return F.lit(low)
    mid = len(first) // 2
    return F.when(key >= first[mid], _place(key, first[mid + 1 :], low + mid + 1)).otherwise(_place(key, first[:mid], low))


def shard(
    docs: DataFrame,
    shards: int = SHARDS,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    piece: int = PIECE,
) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row, and the columns named in ``carry``.

    size is the text's bytes and ``ROW_BYTES``; shards are numbered from 0 and differ from an even share by less than a row's
    size; slots of a shard go from 0 without gaps. Equal texts lie side by side, so they share a shard unless a border falls among
    them. Null texts count as empty; rows with a null id, repeated ids or equal in everything are dealt like any
    others. An empty table gives no rows. Carried columns named like one of the five give way; others are ignored.
    """
    if not 1 <= shards <= MOST_SHARDS:
        raise ValueError(f"1 to {MOST_SHARDS} shards")
    carry = tuple(c for c in carry if c.lower() not in (id_col.lower(), "size", "text_crc32", "shard", "slot"))
    rows = written(keyed(docs, id_col, text_col, carry), "keys")
    rows = rows.withColumn("shard", _place(F.col("key"), borders(rows, shards)).cast("int"))
    sizes = dict(rows.groupBy("shard").count().collect())
    parts = F.element_at(F.array(*[F.lit(max(1, -(-sizes.get(k, 0) // piece))).cast("long") for k in range(shards)]), F.col("shard") + 1)
    rows = rows.withColumn("deal", F.pmod(F.conv(F.substring("key", 33, 15), 16, 10).cast("long"), parts))
    # rows of one id share a deal; where there are too many they are dealt again by their numbers
    crowded = rows.groupBy("shard", "deal").count().filter(F.col("count") > 4 * piece)
    crowded = crowded.select("shard", "deal", F.ceil(F.col("count") / piece).alias("splits"))
    rows = rows.join(crowded, ["shard", "deal"], "left")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("splits", F.lit(1)))).drop("splits")
    counts = rows.groupBy("shard", "deal", "part").agg(F.count("*").alias("n"))
    along = Window.partitionBy("shard").orderBy("deal", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("shard", "deal", "part", (F.sum("n").over(along) - F.col("n")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("shard", "deal", "part").orderBy("key")) - 1 + F.col("offset")
    out = rows.join(offsets, ["shard", "deal", "part"])
    return out.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", place.cast("long").alias("slot"), *[F.col("carried")[c].alias(c) for c in carry])


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard (shard=0, shard=1, ...), its rows as Parquet files; a shard is written by many tasks."""
    sharded.write.mode("overwrite").partitionBy("shard").parquet(path)
