"""Isotonic calibration computes what it is given once, for the fit and for what the fit is applied to."""

from __future__ import annotations

import pytest

from readloom import queries
from readloom.operators import calibrate


def counted(df, seen):
    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(run, df.schema)


def test_predictions_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)
    rows = [(i, 0, k, (1 + (i + k) % 5) / 15) for i in range(60) for k in range(3)] + [(99, 0, 0, 0.5), (99, 0, 1, 0.5)]
    truth = spark.createDataFrame([(i, 0, i % 3) for i in range(60)] + [(7, 0, 2)], "read_id long, pos int, label int")
    given = spark.createDataFrame(rows, "read_id long, pos int, label int, p double")
    out = calibrate.calibrate_labels(counted(given, seen), truth).collect()
    assert seen.value == len(rows)
    assert sorted((r["read_id"], r["label"]) for r in out) == sorted((r[0], r[2]) for r in rows)
    sums: dict = {}
    for r in out:
        sums[r["read_id"]] = sums.get(r["read_id"], 0) + r["p"]
    assert all(x == pytest.approx(1) for x in sums.values())


def test_known_and_other_predictions_agree(spark):
    rows = [(i, 0, k, (1 + (i * 7 + k) % 11) / 30) for i in range(80) for k in range(3)]
    given = spark.createDataFrame(rows, "read_id long, pos int, label int, p double")
    truth = spark.createDataFrame([(i, 0, i % 3) for i in range(80)], "read_id long, pos int, label int")
    own = calibrate.calibrate_labels(given, truth).collect()
    other = calibrate.calibrated(given, truth, given.filter("true"), "isotonic").collect()
    found = [{tuple(r)[:3]: r["p"] for r in rows} for rows in (own, other)]
    assert len(own) == len(other) and found[0] == pytest.approx(found[1])


def test_hits_are_computed_once(spark, sf, monkeypatch):
    seen, hits = spark.sparkContext.accumulator(0), queries._hits
    monkeypatch.setattr(queries, "_hits", lambda *a: counted(hits(*a), seen))
    assert queries.queries()["isotonic_calibrated"](spark, sf).count() == seen.value
