"""License scans (operator 5): diagonal voting over word k-gram hashes.

1. Each document's words give one rolling hash for every k consecutive words.
2. Spark joins all of them to the templates' hashes. A match of document place p with template place t
   votes for the diagonal p - t. The templates are a small fixed table (checked below), so that side
   is broadcast and texts and hashes are never shuffled; only matches are counted, map-side first.
3. Neighbouring diagonals of one template are merged, so that an inserted or missing word doesn't break a
   match: diagonals are dealt into stretches of 2 * ``DRIFT``, twice, the second time half a stretch
   further, so any diagonals within ``DRIFT`` of each other share a stretch and none drifts further.
4. A merged span is verified by the share of the template's places that it covers, each place counted once
   however often it is matched. Hashes only filter: where the words of a match aren't the template's,
   it doesn't count.

Phrases need every k-gram on one diagonal, so they are found where their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readloom.llm.common import WORD_BYTES, as_bytes, slices

K = 2
#: Words by which the diagonals of a span may drift, and the share of a template's k-grams that verifies a span.
DRIFT, COVERAGE = 16, 0.5
#: Template k-grams, at most: what every task may hold (about 40 bytes each).
MOST_GRAMS = 200_000
_BASE, _MARK = np.uint64(0x9E3779B97F4A7C15), -1

# Phrases and the labels that they stand for.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Standard notices of public licenses and the labels that they stand for.
NOTICES = (
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction",
        "mit",
    ),
    (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation",
        "gpl",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "bsd",
    ),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by"),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at",
        "mpl",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice",
        "isc",
    ),
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


def word_hashes(texts: list[list[bytes]]) -> np.ndarray:
    """One XXH64 for each word of all texts; each distinct word is hashed once."""
    known = {w: xxhash.xxh64_intdigest(w) for w in set().union(*texts)}
    return np.fromiter((known[w] for words in texts for w in words), np.uint64, sum(map(len, texts)))


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, as a polynomial in the words' hashes modulo 2**64."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = out * _BASE + hashes[i : i + n]
    return out


def template_grams(templates: Sequence[tuple[str, str, bool]], k: int) -> list[tuple[int, int, str, bool, int, int, bytes]]:
    """(gram, template, label, phrase, grams, place, words) of each place of each template."""
    rows = []
    for i, (text, label, phrase) in enumerate(templates):
        words = words_of(text.encode())
        if len(words) < k:
            raise ValueError(f"a template needs {k} words or more: {text!r}")
        grams = rolling(word_hashes([words]), k).view(np.int64).tolist()
        rows += [(g, i, label, phrase, len(grams), at, b" ".join(words[at : at + k])) for at, g in enumerate(grams)]
    if len({r[0] for r in rows}) != len({r[-1] for r in rows}):
        raise ValueError("two k-grams of the templates have one hash")
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"{len(rows)} template k-grams; {MOST_GRAMS} may be sent to every task. Scan with parts of the templates")
    return rows


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str, bool]] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = K,
) -> DataFrame:
    """One row a document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Phrases are the base: n_base counts all their places, first_word and last_word are the least and
    greatest start (words from 0; null without any) and base_labels their labels. labels adds those of
    notices with a verified span; score is the best coverage of a merged span, verified or not (1 for a
    phrase); spans lists the verified notices as (label, first word, last word, coverage). Labels are distinct, sorted and
    comma-joined, '' if none. Null and empty texts have no words; repeated rows, null ids and ids that
    occur twice stay separate rows; an empty table gives no rows; other columns are ignored.
    """
    if templates is None:
        templates = [*((t, label, True) for t, label in PHRASES), *((t, label, False) for t, label in NOTICES)]
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    listed = template_grams(templates, k)
    meant = {row[0]: row[-1] for row in listed}
    known_grams = np.array(sorted(meant), np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = [words_of(t) for t in as_bytes(batch.column("text"))]
            flat, at, grams, chance = word_hashes(texts).view(np.int64), 0, [], []
            for words in texts:
                own = rolling(flat[at : at + len(words)].view(np.uint64), k).view(np.int64)
                hits = np.flatnonzero(np.isin(own, known_grams)).tolist()
                chance.append([p for p in hits if b" ".join(words[p : p + k]) != meant[int(own[p])]])
                grams.append(np.append(own, _MARK))  # the mark keeps documents without a match
                at += len(words)
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    batch.column("id"),
                    pa.array([len(x) for x in texts], pa.int64()),
                    pa.array(chance, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(grams))),
                ],
                ["row", "id", "n_words", "chance", "grams"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    places = rows.mapInArrow(hashed, f"row long, id {kind}, n_words long, chance array<int>, grams array<long>")
    places = places.select("row", "id", "n_words", "chance", F.posexplode("grams").alias("p", "gram"))
    table = [(_MARK, _MARK, "", False, 0, 0), *(row[:-1] for row in listed)]
    table = F.broadcast(spark.createDataFrame(table, "gram long, template int, label string, phrase boolean, grams int, place int"))
    matches = places.join(table, "gram").filter(~F.array_contains("chance", F.col("p"))).withColumn("diagonal", F.col("p") - F.col("place"))

    own = ["row", "id", "n_words", "template", "label", "phrase", "grams"]
    votes = matches.groupBy(*own, "diagonal").agg(F.count("*").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"), F.collect_set("place").alias("places"))
    # a lone k-gram of a notice is chance; a phrase needs all of its own
    votes = votes.filter((F.col("template") == _MARK) | F.when(F.col("phrase"), F.col("votes") == F.col("grams")).otherwise(F.col("votes") > 1))

    # a phrase's diagonal stands for itself
    twice = F.when(F.col("phrase") | (F.col("template") == _MARK), F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    stretch = F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.floor((F.col("diagonal") + F.col("half") * DRIFT) / (2 * DRIFT)))
    merged = votes.repartition("row").withColumn("half", F.explode(twice)).withColumn("stretch", stretch.cast("long"))
    spans = merged.groupBy(*own, "half", "stretch").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered")
    )
    coverage = F.col("covered") / F.greatest("grams", F.lit(1))
    known = F.col("template") != _MARK
    notice = known & ~F.col("phrase") & (coverage >= COVERAGE)
    base = known & F.col("phrase")

    def labels(which):
        return F.array_join(F.sort_array(F.collect_set(F.when(which, F.col("label")))), ",")

    span = F.struct("label", F.col("low").alias("first"), (F.col("high") + k - 1).alias("last"), coverage.alias("coverage"))
    found = spans.groupBy("row", "id", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("low").cast("long"))).alias("first_word"),
        F.max(F.when(base, F.col("low").cast("long"))).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base | notice).alias("labels"),
        F.coalesce(F.max(F.when(base, 1.0).when(known, coverage)), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_set(F.when(notice, span))).alias("spans"),
    )
    return found.drop("row").withColumn("spans", _apart(F.col("spans"))).withColumnRenamed("id", id_col)


def _apart(spans: Column) -> Column:
    """Of sorted spans, those of one label that overlap as one: from the first word to the last, the best coverage."""
    none = F.slice(spans, 1, 0)

    def joined(a, b):
        return F.struct(
            a["label"].alias("label"), a["first"].alias("first"), F.greatest(a["last"], b["last"]).alias("last"), F.greatest(a["coverage"], b["coverage"]).alias("coverage")
        )

    def add(so_far, s):
        last = F.try_element_at(so_far, F.lit(-1))
        meets = (F.size(so_far) > 0) & (last["label"] == s["label"]) & (s["first"] <= last["last"])
        kept = F.slice(so_far, F.lit(1), F.greatest(F.size(so_far) - 1, F.lit(0)))
        return F.when(meets, F.concat(kept, F.array(joined(last, s)))).otherwise(F.concat(so_far, F.array(s)))

    return F.aggregate(spans, none, add)
