from __future__ import annotations

import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, ties, and clashing column names."""
    rng = random.Random(4)
    words = "the of and Gnu GENERAL public license mit apache cc by été straße naïve x1 2024 — token".split()
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "One two",
        "Released under the MIT License.",
        "gnu general public license apache license cc by mit license",
        "日本語 テキスト です 。",
        "!!! --- ???",
        "long " + " ".join(rng.choices(words, k=30_000)),
    ]
    texts += [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    base = " ".join(rng.choices([f"w{i}" for i in range(500)], k=200))
    texts += [base, base, base + " end", base.upper()]
    rows = [(i, t, rng.choice(["en", "fr", None]), "s", 7) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (12, "another text with an id that is taken", "en", None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    # columns named like those that operators add or use inside
    for name in ("fingerprint", "id", "score", "spans", "items", "n_words", "row", "bucket", "host", "path", "lang_pred"):
        df = df.withColumn(name, df["source"])
    return df.cache()


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.filter("false")
