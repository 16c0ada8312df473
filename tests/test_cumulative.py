from __future__ import annotations

import bisect
import random

import pytest

from readloom.operators import motif
from readloom.sources import tables


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_running_counts_equal_plain_sums(spark, parts):
    rng = random.Random(3)
    values = [rng.choice([None, *range(40)]) for _ in range(500)]
    steps = spark.createDataFrame([(v,) for v in values], "v int").groupBy("v").count()
    found = {r["v"]: (r["count_upto"], r["count_all"]) for r in motif.running_counts(steps, "v", ("count",), parts).collect()}
    order = sorted(-1 if v is None else v for v in values)
    assert found == {v: (bisect.bisect_right(order, -1 if v is None else v), 500) for v in set(values)}


def test_cumulative_leaves_nulls_out(spark):
    rows = spark.createDataFrame([(None,), (1.0,), (1.0,), (3.0,), (float("inf"),)], "v double")
    assert sorted(map(tuple, motif.cumulative(rows, "v").collect())) == [(1.0, 2, 0.5), (3.0, 1, 0.75), (float("inf"), 1, 1.0)]
    assert motif.cumulative(rows.filter("false"), "v").count() == 0
    assert motif.cumulative(rows.filter("v is null"), "v").count() == 0


def test_groups_without_rows_have_no_gap(spark):
    rows = spark.createDataFrame([(1.0, True), (2.0, True)], "score double, grp boolean")
    assert tuple(motif.ks_statistic(rows).first()) == (None, 0, 2)


def test_validation_sets_need_their_columns(spark, tmp_path):
    rows = spark.createDataFrame([("m", 1, 0, 1, [0.25, 0.75]), ("n", 1, 0, 1, [0.5, 0.5])], "model string, read_id long, pos int, label int, probs array<double>")
    rows.write.parquet(f"{tmp_path}/whole")
    predictions, truth = tables.read_validation(spark, f"{tmp_path}/whole")
    assert sorted(map(tuple, predictions.collect()))[1] == ("m", 1, 0, 1, 0.75)
    assert list(map(tuple, truth.collect())) == [(1, 0, 1)]
    rows.drop("probs").write.parquet(f"{tmp_path}/part")
    with pytest.raises(ValueError, match="probs"):
        tables.read_validation(spark, f"{tmp_path}/part")


def test_reports_of_motifs(spark):
    rows = spark.createDataFrame([("ACGT",), ("ACGT",), ("AAAA",)], "sequence string")
    found = motif.report(rows, motif.from_pattern("ACGT")).first().asDict()
    assert (found["n"], found["mode_length"], found["std_length"]) == (3, 4, 0.0)
    assert abs(found["mean_gc"] - 1 / 3) < 1e-12 and abs(found["uniqueness"] - 2 / 3) < 1e-12
