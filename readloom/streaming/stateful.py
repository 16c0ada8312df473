"""Arriving reads with state of their own: first occurrences and per-sample counters, both with an end.

State lives in Spark's state store and is recovered from the checkpoint; timers of event time remove what no late read can need any more,
so state follows the reads of the last while, not of all time.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state needs.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _millis(span: str) -> int:
    return int(pd.Timedelta(span) / timedelta(milliseconds=1))


class FirstOf(StatefulProcessor):
    """Lets a key's first row through (the least time of its batch, then the least id) and forgets the key ``keep`` after its last row."""

    def __init__(self, keep: str, columns: list[str]):
        self.keep, self.columns = _millis(keep), columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "millis bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows, ignore_index=True)
        seen = self.until.exists()
        last = int(every["ts"].max().value // 1_000_000) + self.keep
        if seen:
            before = int(self.until.get()[0])
            last = max(last, before)
            if last != before:
                self.handle.deleteTimer(before)
        self.until.update((last,))
        self.handle.registerTimer(last)
        if not seen:
            yield every.sort_values(["ts", *[c for c in self.columns if c != "ts"]], kind="stable").head(1)[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.until.exists() and int(self.until.get()[0]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_occurrences(reads: DataFrame, key: str, late: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """The first read of each key among reads that are at most ``keep`` apart; ``reads`` have a time ``ts``.

    A key that doesn't come for ``keep``, as the watermark (``late`` behind the latest read) sees it, is forgotten and its next read is a first one
    again. Reads later than the watermark are left out. Reads with a null key are all let through by no key: they are dropped.
    """
    columns = reads.columns
    timed = reads.filter(F.col(key).isNotNull()).withColumn("_key", F.col(key)).withWatermark("ts", late)
    return timed.groupBy("_key").transformWithStateInPandas(
        statefulProcessor=FirstOf(keep, columns), outputStructType=reads.schema, outputMode="Append", timeMode="EventTime"
    )


class Counters(StatefulProcessor):
    """A sample's counters; when it is silent for ``quiet``, they are given out once as final and forgotten."""

    def __init__(self, quiet: str):
        self.quiet = _millis(quiet)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "total bigint, valid bigint, bases bigint, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, valid, bases, until = self.sums.get() if self.sums.exists() else (0, 0, 0, 0)
        before = until
        for part in rows:
            total, valid = total + len(part), valid + int((part["classification"] == "valid").sum())
            bases += int(part["sequence"].str.len().fillna(0).sum())
            until = max(until, int(part["ts"].max().value // 1_000_000) + self.quiet)
        if until != before:
            if before:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(until)
        self.sums.update((total, valid, bases, until))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            total, valid, bases, until = self.sums.get()
            if until <= expiredTimerInfo.getExpiryTimeInMs():
                self.sums.clear()
                yield pd.DataFrame({"sample_name": [key[0]], "total": [total], "valid": [valid], "bases": [bases], "until": [pd.Timestamp(until, unit="ms")]})

    def close(self) -> None:
        pass


def finished_samples(reads: DataFrame, late: str = "10 minutes", quiet: str = "1 hour") -> DataFrame:
    """(sample_name, total, valid, bases, until): the counters of each sample that has had no read for ``quiet``, once.

    ``reads``: sample_name, classification, sequence and ts. A sample that goes on later is counted anew, from its next read on.
    """
    timed = reads.filter("sample_name is not null").select("sample_name", "classification", "sequence", "ts").withWatermark("ts", late)
    return timed.groupBy("sample_name").transformWithStateInPandas(
        statefulProcessor=Counters(quiet),
        outputStructType="sample_name string, total bigint, valid bigint, bases bigint, until timestamp",
        outputMode="Append",
        timeMode="EventTime",
    )
