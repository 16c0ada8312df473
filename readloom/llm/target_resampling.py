"""Target-distribution importance resampling (operator 12): documents drawn towards a target's n-grams.

Features are runs of 1 to n consecutive words, hashed into buckets. A bucket's gain is the logarithm of its share among
the target's features over its share among the documents'; a document's weight is the mean gain of its features, and
documents are drawn without replacement in proportion to its exponential (the highest of weight plus Gumbel noise).

1. Each batch of texts gets a suffix array over its words' numbers, sorted as far as n words, with the number of words
   that neighbouring suffixes share (LCP). A stretch of the array whose LCP is m or more is one n-gram of m words with all
   its occurrences: it is hashed once (going on from the hash of its first m - 1 words), and the bucket is scattered
   back to its occurrences. The buckets of each document are stored, so texts are read and hashed once.
2. Buckets are counted by task and added up; there are ``buckets`` sums, which are sent to every task.
3. Scores are whole numbers. They lie within bounds that the data can't move (weights by the logarithm of a count of
   64 bits, noise by that of 2^32), so the counts of documents by score are a small table. It gives each score the number of
   documents above it; only documents of one score, 0.04 % of all at most for equal weights, are numbered by a window.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import WORD_BYTES, as_bytes, slices, written

WORDS, BUCKETS, SEED = 2, 10_000, 7
#: Of the documents with so many words, so many in a hundred are drawn.
LEAST_WORDS, PERCENT = 20, 25
#: Bytes of text that get one suffix array.
BATCH = 8 << 20
#: Scores that there can be: weights within 1000 ln(2^63 (2^63 + buckets)), noise from -1000 ln(33 ln 2) to 1000 ln(2^33).
MOST_SCORES = 250_000


def suffixes(words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of the n numbers from each of them on, and how many of these each shares with the one before it.

    Beyond the end there is a number below all others.
    """
    rank = words.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    ranks = [rank]
    top = int(words.max()) + 2 if len(words) else 2
    for d in range(1, n):
        after = np.concatenate([words[d:] + 1, np.zeros(min(d, len(words)), words.dtype)])
        keys = rank * top + after
        order = np.argsort(keys, kind="stable")
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(np.diff(keys[order], prepend=keys[order[:1]]) != 0)
        ranks.append(rank)
    shared = np.zeros(len(words), np.int64)
    for r in ranks:
        shared[1:] += r[order[1:]] == r[order[:-1]]
    return order, shared


def buckets_of(texts: list[bytes | None], n: int = WORDS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The texts' numbers of words, and for m = 1 to n the buckets of all n-grams of m words, text by text, with their counts.

    Words are runs of ASCII digits, letters and bytes of other characters, A-Z lower-cased; a bucket is the
    remainder of the CRC-32 of the words joined by a space.
    """
    split = [(t or b"").translate(WORD_BYTES).split() for t in texts]
    known = {w: i for i, w in enumerate(set().union(*split), 1)}
    vocabulary = [b"", *known]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    number = known.__getitem__
    # 0 after each text: no n-gram goes on over it
    words = np.fromiter((x for part in split for x in (*map(number, part), 0)), np.int64, int(sizes.sum()) + len(split))
    ends = np.cumsum(sizes + 1)
    left = np.repeat(ends - 1, sizes + 1) - np.arange(len(words))
    order, shared = suffixes(words, n)
    found, counts = [], []
    spaced = [b" " + w for w in vocabulary]
    crc = np.zeros(len(words), np.int64)  # of the n-gram at each position, one word longer each time
    for m in range(1, n + 1):
        first = np.flatnonzero(shared < m)
        at = order[first]
        whole = left[at] >= m
        start = at[whole]
        last = words[start + m - 1].tolist()
        if m == 1:
            hashes = [zlib.crc32(vocabulary[w]) for w in last]
        else:
            hashes = [zlib.crc32(spaced[w], c) for w, c in zip(last, crc[start].tolist())]
        value = np.zeros(len(first), np.int64)
        value[whole] = hashes
        crc[order] = np.repeat(value, np.diff(first, append=len(words)))
        found.append(crc[left >= m] % buckets)
        counts.append(np.maximum(sizes - m + 1, 0))
    return sizes, found, counts


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def features(rows: DataFrame, text_col: str, n: int = WORDS, buckets: int = BUCKETS, id_col: str | None = None) -> DataFrame:
    """(id, n_words, features): the buckets of each text's n-grams, as packed numbers. No shuffle. Without ``id_col`` the id is null."""
    picked = rows.select((F.col(id_col) if id_col else F.lit(None).cast("long")).alias("id"), F.col(text_col).alias("text"))
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", BATCH):
            sizes, found, counts = buckets_of(as_bytes(batch.column("text")), n, buckets)
            flat = [x.astype(kind) for x in found]
            ends = [np.cumsum(c).tolist() for c in counts]
            packed, before = [], [0] * n
            for now in zip(*ends):
                packed.append(b"".join(x[a:b].tobytes() for x, a, b in zip(flat, before, now)))
                before = now
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes), pa.array(packed, pa.binary())], ["id", "n_words", "features"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, n_words long, features binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features are in each bucket; a task hands on a row a bucket at most, the driver holds ``buckets`` numbers."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in slices(batches, "features", BATCH):
            total += np.bincount(np.frombuffer(b"".join(batch.column("features").to_pylist()), kind), minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["bucket", "n"])

    rows = found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    out[[r["bucket"] for r in rows]] = [r["n"] for r in rows]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 ln of each bucket's share of the target over its share of the source, one added to each count, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    pairs = zip(source.tolist(), target.tolist())
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in pairs], np.int64)


def noise(id_: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, rounded down: a hash of seed and id; null for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), id_.cast("string")).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    n: int = WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """(id, n_features, weight, score, rank): every row's weight and score, and the place of those that are drawn.

    Of the N rows with an id and ``least_words`` words, floor(percent N / 100) of the highest score are drawn,
    ties to the smaller id; rank is 1 for the first and null for rows that aren't drawn. weight is the mean of 1000 ln gains,
    rounded down, of a row's features, repeats included, 0 without one. A null id has no score and is never drawn; a null
    text counts as empty. Repeated rows count each time and are drawn each for itself; an empty table gives no rows; with an
    empty target, gains favour rare buckets. Other columns are ignored.
    """
    found = written(features(docs, text_col, n, buckets, id_col), "features")
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, target_text_col, n, buckets), buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gain)
    kind = _kind(buckets)
    width = int(kind[-1])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "features", BATCH):
            parts = batch.column("features").to_pylist()
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // width
            sums = np.concatenate([[0], np.cumsum(sent.value[np.frombuffer(b"".join(parts), kind)])])
            ends = np.cumsum(sizes)
            weight = (sums[ends] - sums[ends - sizes]) // np.maximum(sizes, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), pa.array(sizes), pa.array(weight)], ["id", "n_words", "n_features", "weight"]
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    weighed = found.mapInArrow(weigh, f"id {id_type}, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed)), "scores")
    fit = (F.col("n_words") >= least_words) & F.col("id").isNotNull()
    return _ranked(scored, fit, percent).withColumnRenamed("id", id_col)


def _ranked(scored: DataFrame, fit: Column, percent: int) -> DataFrame:
    columns = ["id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    by_score = scored.filter(fit).groupBy("score").count().limit(MOST_SCORES + 1).collect()
    if len(by_score) > MOST_SCORES:
        raise ValueError(f"more than {MOST_SCORES} scores")
    by_score.sort(key=lambda r: -r["score"])
    most, above, sure = percent * sum(r["count"] for r in by_score) // 100, 0, []
    for r in by_score:
        if above >= most:
            break
        sure.append((r["score"], above))
        above += r["count"]
    if not sure:
        return scored.select(*columns, none)
    drawn = fit & (F.col("score") >= sure[-1][0])
    # one row a score: MOST_SCORES rows at most
    offsets = F.broadcast(scored.sparkSession.createDataFrame(sure, "score long, above long"))
    place = F.row_number().over(Window.partitionBy("score").orderBy("id")) + F.col("above")
    high = scored.filter(drawn).join(offsets, "score").select(*columns, F.when(place <= most, place).cast("long").alias("rank"))
    return high.unionByName(scored.filter(~F.coalesce(drawn, F.lit(False))).select(*columns, none))


def drawn(docs: DataFrame, ranked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, whose id ``resample`` has drawn; rows of one id come together."""
    return docs.join(ranked.filter("rank is not null").select(id_col), id_col, "left_semi")
