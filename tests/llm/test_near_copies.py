"""Near copies that differ in one block, and short ones: the pipeline's stage has to find them."""

from __future__ import annotations

import random

import pytest

from readloom.llm import simhash_vptree


def shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def block_copy(words, other, form):
    n = len(words)
    if form == "cut":
        return words[: n - n // 10]
    if form == "appended":
        return words + other[: n // 8]
    return words[: n // 2] + other[: n // 12] + words[n // 2 + n // 12 :]


def pairs_of(form, rng):
    vocabulary = [f"word{i}" for i in range(3000)]
    size = (26, 38) if form.startswith("short") else (100, 300)
    out = []
    while len(out) < 120:
        words = rng.choices(vocabulary, k=rng.randint(*size))
        copy = words[:-2] if form == "short" else block_copy(words, rng.choices(vocabulary, k=300), form)
        a, b = " ".join(words), " ".join(copy)
        if likeness(a, b) >= 0.8:
            out.append((a, b))
    return out


@pytest.mark.parametrize("form", ["cut", "appended", "replaced", "short"])
def test_block_and_short_copies_go(spark, form):
    pairs = pairs_of(form, random.Random(5))
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(10_000 + i, b) for i, (_, b) in enumerate(pairs)]
    kept = simhash_vptree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(len(pairs))) <= ids
    assert sum(i >= 10_000 for i in ids) <= 0.02 * len(pairs)


def test_texts_below_the_similarity_stay(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 60)) for _ in range(2)]
    texts.append(" ".join(texts[0].split()[:40] + texts[1].split()[:20]))
    rows = list(enumerate(texts))
    assert simhash_vptree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 3
