"""The order of a user's segments is judged over all of the user's events, not their first ones."""

from __future__ import annotations

from itertools import groupby

import pytest

from readloom import queries

ORDER = ("UMI", "ACC", "cDNA", "CBC")
NAMES = {"click": "UMI", "error": "XX", "purchase": "ACC", "signup": "CBC", "view": "cDNA"}


def in_order(found):
    best = [0] * (len(ORDER) + 1)
    for x in found:
        old = best[:]
        for j, y in enumerate(ORDER, 1):
            best[j] = old[j - 1] + 1 if x == y else max(old[j], best[j - 1])
    return best[-1]


def test_architecture_is_that_of_all_events(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("user_id", "ts", "event_id", "event_type").collect()
    want = {}
    for user, own in groupby(sorted(rows, key=lambda r: (r["user_id"], r["ts"], r["event_id"])), lambda r: r["user_id"]):
        want[user] = in_order([NAMES.get(label, "XX") for label, _ in groupby(r["event_type"] for r in own)]) / len(ORDER)
    got = {r["read_id"]: r["order_score"] for r in queries.architecture_validate(spark, sf).collect()}
    assert got == pytest.approx(want)
