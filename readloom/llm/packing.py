"""Packing (operator 9): first-fit decreasing with a tournament tree of bin capacities.

1. Each document is tokenised once, where it is read, and cut into pieces of at most one sequence;
   only the pieces' lengths and digests go on (no shuffle of texts or ids).
2. A piece that fills a sequence stands alone. What is left of each document, one piece, is dealt into
   random groups of documents, each packed on its own: pieces in decreasing length, each into the
   first sequence that has room, found by descending a tournament tree over the sequences' free places.
   A document's group is a hash of its id and length, whatever file it is in; a group that grows too large,
   as many rows share both, is dealt again by row.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import slices, written

SEQUENCE = 1_024
#: Documents in a group, about. Larger groups leave less padding; they take more memory in a task.
GROUP = 16_384
SEED = 9
END_ID = 0
VOCABULARY = "byte_bpe_50k"
PIECE = ("id", "start", "length", "ids_crc32", "doc_tokens")


@cache
def encoder(vocabulary: str, folder: str | None) -> Callable[[str], list[int]]:
    """ids of a text by the public vocabulary file ``{folder}/{vocabulary}.json``.

    The same ranks drive tiktoken, which gives the same ids several times faster; a text that spells
    out a special token goes to the tokenizers library, which gives that token's id.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    def place(name: str) -> str:
        return f"{folder}/{name}" if folder else public_tokenizers.path(name)

    with open(place(f"{vocabulary}.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    full = Tokenizer.from_file(place(f"{vocabulary}.json"))
    special = [t.content for t in full.get_added_tokens_decoder().values()]

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each document's ids and an end id, cut every ``size`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, folder)
        for batch in slices(batches, "text", 8 << 20):
            rows, out = [], ([], [], [], [])
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                for start in range(0, len(ids), size):
                    cut = ids[start : start + size]
                    rows.append(i)
                    for column, value in zip(out, (start, len(cut), zlib.crc32(cut.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int32())), *(pa.array(x, pa.int64()) for x in out)],
                ["id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each length: decreasing, ties in the given order, first bin with room."""
    order = np.argsort(-lengths, kind="stable")
    leaves = 1 << max(0, int(len(lengths) - 1).bit_length())
    # tree[1] is the root; a node holds the most room in any bin below it; unopened bins are empty
    tree = [size] * (2 * leaves)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - leaves, size - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
    return bins, offsets


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SEQUENCE,
    group: int = GROUP,
    vocabulary: str = VOCABULARY,
    folder: str | None = None,
) -> DataFrame:
    """One row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    A document is its ids and one end id, so a null or empty text is one id long. Pieces of a full
    sequence stand alone; every document's rest shares sequences with those of its random group.
    ``padded`` is the length that the sequence is stored with: ``size``, or its own if that is a power
    of two. Repeated rows and null ids are packed like any other; an empty table gives no rows; other
    columns are ignored.
    """
    cut = pieces(docs, id_col, text_col, size, vocabulary, folder).withColumn("row", F.monotonically_increasing_id())
    cut = written(cut, "pieces")
    kind = cut.schema["id"].dataType.simpleString()
    alone = cut.filter(F.col("length") == size).select(
        *PIECE, (F.lit(1 << 62) + F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.col("length").alias("padded")
    )
    rest = cut.filter(F.col("length") < size)
    groups = max(1, -(-rest.count() // group))
    rest = rest.withColumn("grp", F.pmod(F.xxhash64("id", "doc_tokens", F.lit(SEED)), F.lit(groups)))
    sizes = rest.groupBy("grp").agg(F.ceil(F.count("*") / (2 * group)).alias("parts"))
    dealt = rest.join(sizes, "grp").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")))
    # 20 bits each for parts of a group and for sequences of a part
    dealt = dealt.withColumn("grp", F.shiftleft("grp", 20) + F.col("part")).select(*PIECE, "grp")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        # in an order of their own, so that the same pieces give the same sequences
        part = part.sort_by([("length", "descending"), ("id", "ascending"), ("ids_crc32", "ascending")])
        lengths = part.column("length").to_numpy()
        bins, offsets = first_fit_decreasing(lengths, size)
        filled = np.bincount(bins, lengths).astype(np.int64)
        padded = np.where((filled & (filled - 1)) == 0, filled, size)
        part = part.append_column("sequence_id", pa.array((key[0].as_py() << 20) + bins))
        part = part.append_column("offset", pa.array(offsets))
        return part.append_column("padded", pa.array(padded[bins])).drop_columns(["grp"])

    packed = dealt.groupBy("grp").applyInArrow(
        run,
        f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded long",
    )
    return packed.unionByName(alone).withColumnRenamed("id", id_col)
