from __future__ import annotations

import time

from pyspark.sql import functions as F

from readloom.operators import simulate


def test_errors_of_long_reads_take_work_by_length(spark):
    n = 60_000
    reads = spark.range(1).select(F.col("id").alias("read_id"), F.repeat(F.lit("ACGT"), n // 4).alias("sequence"), F.array_repeat(F.lit("x"), n).alias("labels"), F.lit(None).alias("quality"))
    start = time.monotonic()
    row = simulate.sequencing_errors(reads, 3, 0.05).first()
    assert time.monotonic() - start < 20  # a read split again at every place takes minutes
    labels = row["labels"]
    assert len(labels) == len(row["sequence"])
    assert 0.03 * n < labels.count("ERROR_SUB") < 0.04 * n and 0.006 * n < labels.count("ERROR_INS") < 0.009 * n


def test_errors_of_odd_reads(spark):
    rows = [(1, "ACGNT", list("abcde")), (2, "ACG", ["a"]), (3, "", []), (4, None, None), (5, "AC", None), (6, "AC", list("abc"))]
    reads = spark.createDataFrame(rows, "read_id long, sequence string, labels array<string>").withColumn("quality", F.lit(None))

    def found(*shares):
        return {r["read_id"]: (r["sequence"], r["labels"]) for r in simulate.sequencing_errors(reads, 3, *shares).collect()}

    assert found(0.0) == {1: ("ACGNT", list("abcde")), 2: ("ACG", ["a", None, None]), 3: ("", []), 4: ("", []), 5: ("AC", [None, None]), 6: ("AC", ["a", "b"])}
    for k, (text, labels) in found(1.0, 1.0, 0.0).items():
        given = rows[k - 1][1] or ""
        assert len(text) == len(given) and all(a != b and b in "ACGT" for a, b in zip(given, text)) and labels == ["ERROR_SUB"] * len(given)
    for k, (text, labels) in found(1.0, 0.0, 1.0).items():
        given, own = rows[k - 1][1] or "", [*(rows[k - 1][2] or []), *[None] * 5]
        assert text[::2] == given and labels == [x for v in own[: len(given)] for x in (v, "ERROR_INS")]
    assert all(v == ("", []) for v in found(1.0, 0.0, 0.0).values())
