"""Fits over sums: nothing is left to gain where they stop."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom import queries, scale_queries
from readloom.operators import calibrate, combine, ensemble
from readloom.plans import inputs
from tests.test_calibration import pooled


def test_isotonic_steps_of_a_thousand_labels(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice([round(rng.random(), 2), 0.5, 1.0]), rng.random() < 0.3) for k in range(1_000) for _ in range(rng.choice([1, 3, 30]))]
    rows += [(7, i / 5_000, rng.random() < i / 5_000) for i in range(5_000)] + [(8, 0.25, i % 3 == 0) for i in range(3_000)]
    rows += [(None, 0.5, True), (1, None, True), (1, 0.5, None)]
    given = spark.createDataFrame(rows, "label int, p double, hit boolean").repartition(9)
    blocks = calibrate.isotonic_blocks(given)
    got: dict[int, list] = {}
    for r in blocks.collect():
        got.setdefault(r["label"], []).append((r["low"], r["high"], r["n"], r["hits"]))
    own: dict[int, list] = {}
    for k, p, h in rows:
        if None not in (k, p, h):
            own.setdefault(k, []).append((p, float(h)))
    assert set(got) == set(own)
    for k, found in got.items():
        want = pooled(own[k])
        for low, high, n, hits in found:
            assert all(math.isclose(want[p], hits / n) for p, _ in own[k] if low <= p <= high)
        assert sum(b[2] for b in found) == len(own[k])
    plan = calibrate.isotonic_blocks(given)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1
    out = calibrate.with_isotonic(given.na.drop(), blocks).collect()
    assert len(out) == len(rows) - 3 and all(0 <= r["p"] <= 1 for r in out)


def test_temperature_has_no_slope_left(spark, sf):
    sharp, truth = scale_queries._sharp(spark, sf)
    found = calibrate.fit_temperature(sharp, truth)
    assert abs(found.gradient) < 1e-6 and 0.1 < found.temperature < 10 and found.passes < 20
    for t in (found.temperature * 0.9, found.temperature * 1.1):
        worse = ensemble.with_temperature(sharp, t).join(truth, ["read_id", "pos", "label"]).agg(-F.avg(F.log("p"))).first()[0]
        assert worse > found.nll
    cold = sharp.withColumn("p", F.when(F.col("read_id") >= 0, F.col("p"))).join(truth.withColumnRenamed("label", "t"), ["read_id", "pos"])
    sure = cold.select("read_id", "pos", "label", F.when(F.col("label") == F.col("t"), 0.4).otherwise(0.2).alias("p"))
    assert calibrate.fit_temperature(sure, truth).temperature == pytest.approx(0.1)
    wrong = cold.select("read_id", "pos", "label", F.when(F.col("label") == F.col("t"), 0.1).otherwise(0.3).alias("p"))
    assert calibrate.fit_temperature(wrong, truth).temperature == pytest.approx(10.0)
    assert calibrate.fit_temperature(sharp.filter("false"), truth).temperature == 1.0


def test_curves_of_many_labels(spark):
    rng = random.Random(3)
    rows = []
    for k in range(40):
        a, b = rng.uniform(0.5, 2), rng.uniform(-1, 1)
        for _ in range(200):
            x = rng.gauss(0, 1)
            rows.append((k, 1 / (1 + math.exp(-x)), rng.random() < 1 / (1 + math.exp(-(a * x + b)))))
    rows += [(99, 0.3, True), (99, 0.6, True)]
    curves = calibrate.fit_platt(spark.createDataFrame(rows, "label int, p double, hit boolean"))
    assert set(curves) == {*range(40), 99}
    for k in range(40):
        x = np.array([math.log(p / (1 - p)) for label, p, _ in rows if label == k])
        y = np.array([h for label, _, h in rows if label == k], float)
        r = 1 / (1 + np.exp(-(curves[k][0] * x + curves[k][1]))) - y
        assert abs(r.mean()) < 1e-6 and abs((r * x).mean()) < 1e-6


def test_stacked_models_never_saw_what_they_score(spark, sf):
    p, t = inputs.predictions(spark, sf), inputs.truth(spark, sf)
    labels = list(range(inputs.CLASSES))
    model = calibrate.fit_stack(p, t, labels, folds=3)
    assert model.gradients.max() < 1e-6
    truth = {(r["read_id"], r["pos"]): r["label"] for r in t.collect()}
    cells = {}
    for r in p.collect():
        cells.setdefault((r["read_id"], r["pos"]), np.append(np.zeros(12), 1.0))[inputs.MODELS.index(r["model"]) * 4 + r["label"]] = r["p"]
    folds = {r["read_id"]: r["f"] for r in p.select("read_id", calibrate.fold_of(F.col("read_id"), 3).alias("f")).distinct().collect()}
    # the gradient over the other folds' places is nothing but the weights' own
    for f in range(3):
        rows = [k for k in cells if folds[k[0]] != f]
        x, y = np.array([cells[k] for k in rows]), np.eye(4)[[truth[k] for k in rows]]
        z = x @ model.weights[f]
        q = np.exp(z - z.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
        held = np.ones((13, 1))
        held[-1] = 0
        assert np.abs(x.T @ (q - y) + held * model.weights[f]).max() / len(rows) < 1e-6
    for r in calibrate.stacked(p, model).filter("read_id < 20").collect():
        z = cells[r["read_id"], r["pos"]] @ model.weights[folds[r["read_id"]]]
        q = np.exp(z - z.max())
        assert r["p"] == pytest.approx(q[r["label"]] / q.sum())


def test_stacking_takes_missing_cells_and_empty_tables(spark):
    p = spark.createDataFrame([("a", 1, 0, 0, 0.9), ("a", 1, 0, 1, 0.1), ("b", 2, 0, 1, 0.7), ("b", 2, 0, 1, None), ("b", 3, 0, 9, 0.4)], "model string, read_id long, pos int, label int, p double")
    t = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 0, 9)], "read_id long, pos int, label int")
    out = combine.predict(p, p, t, "stacking", labels=[0, 1], folds=2)
    sums = {r["read_id"]: r["s"] for r in out.groupBy("read_id").agg(F.sum("p").alias("s")).collect()}
    assert set(sums) == {1, 2} and all(s == pytest.approx(1) for s in sums.values())
    with pytest.raises(ValueError):
        combine.predict(p, p, t, "stacking")
    with pytest.raises(ValueError):
        combine.weights(p, t, "other")


def test_intervals_are_percentiles_of_the_draws(spark, sf):
    """The same draws, one after another."""
    from readloom.functions.draws import pick

    p = inputs.predictions(spark, sf).filter("read_id < 12")
    w = dict(queries.WEIGHTS)
    models = sorted(w)
    slots = spark.range(100).select(F.col("id").alias("d"), F.explode(F.array(*map(F.lit, range(3)))).alias("s"))
    draws: dict[int, list[str]] = {}
    for r in slots.select("d", pick(7, 3, F.col("d"), F.col("s")).alias("m")).collect():
        draws.setdefault(r["d"], []).append(models[r["m"]])
    cells: dict[tuple, dict] = {}
    for r in p.collect():
        cells.setdefault((r["read_id"], r["pos"], r["label"]), {})[r["model"]] = r["p"]
    got = {(r["read_id"], r["pos"], r["label"]): (r["low"], r["high"]) for r in ensemble.intervals(p, queries._weights(spark)).collect()}
    assert set(got) == set(cells)
    for key, own in cells.items():
        means = [sum(w[m] * own[m] for m in d) / sum(w[m] for m in d) for d in draws.values()]
        assert got[key] == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))


def test_bounds_reach_the_runs_without_a_shuffle_of_them(spark):
    from readloom.operators import evaluate

    runs = spark.createDataFrame([("A", i % 4) for i in range(100)] + [("B", 1), ("C", 9)], "label string, n int")
    bounds = spark.createDataFrame([("A", 1, 2), ("B", 1, 1), ("Z", 1, 1)], "label string, min_len int, max_len int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = evaluate.satisfaction(runs, bounds)
        got = {r["label"]: (r["runs"], r["satisfied"], r["exact"], r["violations"]) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"A": (100, 0.5, 0.25, 50), "B": (1, 1.0, 1.0, 0), "Z": (0, 0.0, 0.0, 0)}
    assert "BroadcastHashJoin" in plan


@pytest.mark.parametrize("way", ["average", "logit_average", "rank_average"])
def test_averages_shuffle_once(spark, sf, way):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = getattr(ensemble, way)(inputs.predictions(spark, sf).select("model", "read_id", "pos", "label", "p"), queries._weights(spark))
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    # one by (model, read, pos) normalises the inputs; one is the operator's
    assert plan.count("Exchange hashpartitioning(read_id") <= 1
