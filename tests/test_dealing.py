from __future__ import annotations

import pytest

from readloom.operators import ensemble
from readloom.plans import inputs

WEIGHTS = [("m0", 0.5), ("m1", 0.3), ("m2", 0.2)]


@pytest.fixture
def weights(spark):
    return spark.createDataFrame(WEIGHTS, "model string, weight double")


def _predictions(spark, folder, ids):
    spark.createDataFrame([(i,) for i in ids], "doc_id long").write.parquet(f"{folder}/documents.parquet")
    return inputs.predictions(spark, str(folder))


@pytest.mark.parametrize("way", ["average", "confidence", "logit_average", "rank_average", "posterior_variance"])
def test_tasks_grow_in_number_and_not_in_size(spark, tmp_path, monkeypatch, weights, way):
    given = _predictions(spark, tmp_path, range(40))
    monkeypatch.setattr(ensemble, "TASK_ROWS", 100, raising=False)
    found = ensemble.average(given, weights, True) if way == "confidence" else getattr(ensemble, way)(given, weights)
    assert found.count() == 40 * 32
    assert found.rdd.getNumPartitions() == -(-40 * 96 // 100)


def test_equal_probabilities_have_the_lower_label(spark, tmp_path, weights):
    """Labels as probable as each other, whose sums over the models differ in the last bits."""
    found = ensemble.predict(_predictions(spark, tmp_path, [326, 1277, 1344, 2540]), weights)
    labels = {(r["read_id"], r["pos"]): r["label"] for r in found.collect()}
    assert [labels[x] for x in ((326, 2), (1277, 0), (1344, 0), (2540, 7))] == [1, 0, 1, 0]


def test_probabilities_need_no_shuffle(spark, tmp_path):
    given = _predictions(spark, tmp_path, range(20))
    assert "Exchange" not in given._jdf.queryExecution().executedPlan().toString()
    sums = given.groupBy("model", "read_id", "pos").sum("p").collect()
    assert len(sums) == 20 * 3 * 8 and all(abs(r["sum(p)"] - 1) < 1e-12 for r in sums)
