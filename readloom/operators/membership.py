"""Rows whose value is in a list of millions: a filter of hashed bits goes before the join, so most other rows are never shuffled.

The bits are set where the list is read and joined by OR; they are sent to every task only if they are small enough, and the join that
follows takes out what the filter lets through by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each value of the list and probes of a value: about 1 % of other rows pass. Bytes that may be sent to every task.
BITS, PROBES, MOST_BYTES = 10, 7, 256 << 20


@dataclass
class Bloom:
    words: Broadcast | None  # none: the list is too large, every row passes
    bits: int

    def may_hold(self, *columns: Column) -> Column:
        """False only where the list surely has no such value; false for a null."""
        known = columns[0].isNotNull()
        for c in columns[1:]:
            known = known & c.isNotNull()
        if self.words is None:
            return known
        sent, bits = self.words, self.bits

        @F.pandas_udf("boolean")
        def probe(a: pd.Series, b: pd.Series) -> pd.Series:
            places = _places(a.to_numpy(), b.to_numpy(), bits)
            words = sent.value
            return pd.Series(np.logical_and.reduce([(words[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) != 0 for p in places]))

        return known & probe(*_hashes(columns))


def _hashes(columns: tuple[Column, ...]) -> tuple[Column, Column]:
    return F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)


def _places(a: np.ndarray, b: np.ndarray, bits: int) -> list[np.ndarray]:
    x, y = a.astype(np.int64).view(np.uint64), b.astype(np.int64).view(np.uint64) | np.uint64(1)
    return [((x + np.uint64(i) * y) % np.uint64(bits)).astype(np.int64) for i in range(PROBES)]


def bloom(listed: DataFrame, by: list[str], bits_each: int = BITS, most_bytes: int = MOST_BYTES) -> Bloom:
    """The filter of a list's values. A task hands on a word of 64 bits at most once; the driver holds the words that are set."""
    n = listed.count()
    bits = max(64, -(-n * bits_each // 64) * 64)
    if bits // 8 > most_bytes:
        return Bloom(None, bits)

    def run(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            for p in _places(batch["a"].to_numpy(), batch["b"].to_numpy(), bits):
                np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
        there = np.flatnonzero(words)
        yield pd.DataFrame({"word": there, "set": words[there].view(np.int64)})

    a, b = _hashes(tuple(F.col(c) for c in by))
    rows = listed.select(a.alias("a"), b.alias("b")).mapInPandas(run, "word long, set long")
    found = rows.groupBy("word").agg(F.bit_or("set").alias("set")).toPandas()
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["set"].to_numpy(dtype=np.int64).view(np.uint64)
    return Bloom(listed.sparkSession.sparkContext.broadcast(words), bits)


def members(rows: DataFrame, listed: DataFrame, by: list[str], bits_each: int = BITS) -> DataFrame:
    """Rows whose values of ``by`` are in the list: filtered by bits, then joined. Nulls are in no list; repeated entries count once."""
    keys = listed.select(*by).na.drop()
    held = bloom(keys, by, bits_each)
    return rows.filter(held.may_hold(*[F.col(c) for c in by])).join(keys, by, "left_semi")


def probed(rows: DataFrame, table: DataFrame, by: list[str], bits_each: int = BITS) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row for each value of ``by``): rows that the filter rules out aren't shuffled for the join."""
    held = bloom(table.select(*by).na.drop(), by, bits_each)
    may = F.coalesce(held.may_hold(*[F.col(c) for c in by]), F.lit(False))
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in by]
    columns = [*rows.columns, *[c for c in table.columns if c not in by]]
    hit = rows.filter(may).join(table, by, "left").select(columns)
    return hit.unionByName(rows.filter(~may).select(*rows.columns, *others))
