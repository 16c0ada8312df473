"""What the representatives of the bands leave apart is linked all the same."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import simhash_vptree
from tests.llm import brute


def chained(rng, groups, steps):
    """Texts of a group share four fifths with the one before only, so that a representative is like two of them."""
    rows = []
    for g in range(groups):
        words = [f"g{g}w{i}" for i in range(60)]
        for s in range(steps):
            rows.append((g * 1_000 + s, " ".join(words)))
            for i in range(2):
                words[(2 * s + i) % 60 if g % 2 else 59 - (2 * s + i) % 60] = f"g{g}s{s}n{i}"
    rng.shuffle(rows)
    return rows


def test_nothing_is_left_apart_without_representatives(spark, monkeypatch):
    """Whatever the bands link, nothing included, groups are those of all pairs (with four rounds of representatives alone 11 rows stayed, not 9)."""
    rows = chained(random.Random(1), 6, 20) + [(90_000, None), (90_001, " "), (90_002, "one two"), (90_003, "One  two"), (90_004, "one two three")]
    want = set(brute.near_copies(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_vptree.one_of_each(docs).collect()} == want
    monkeypatch.setattr(simhash_vptree, "similar_links", lambda classes, *_: classes.select("node", F.col("node").alias("b")))
    assert {r["doc_id"] for r in simhash_vptree.one_of_each(docs).collect()} == want


@pytest.mark.parametrize("frequent", [0, 20, 200])
def test_prefixes_of_alike_texts_meet(frequent):
    rng = random.Random(frequent)
    often = np.sort(np.array(rng.sample(range(300), frequent), np.uint64))
    counts = np.array([rng.randint(3, 9) for _ in range(frequent)], np.int64)
    for _ in range(2_000):
        a = set(rng.sample(range(300), rng.randint(1, 60)))
        b = set(rng.sample(sorted(a), rng.randint(max(1, len(a) * 3 // 4), len(a)))) | set(rng.sample(range(300), rng.randint(0, 6)))
        first = [set(simhash_vptree.shingle_prefix(np.array(sorted(x), np.uint64), often, counts).tolist()) for x in (a, b)]
        if 5 * len(a & b) >= 4 * len(a | b):
            assert first[0] & first[1]
