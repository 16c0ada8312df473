from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from readloom.plans import ensembles, inputs
from readloom.plans.settings import AllSettings, DemuxSettings, EnsembleSettings, LengthSettings, MatrixSettings


def test_sections_are_read_and_written(tmp_path):
    given = {"demux": {"required": ["UMI"], "most_distance": 1}, "lengths": {"bounds": {"UMI": [8, 8]}}, "ensemble": {"method": "voting", "calibration": "platt"}}
    (tmp_path / "s.json").write_text(json.dumps(given))
    found = AllSettings.load(str(tmp_path / "s.json"))
    assert found.demux == DemuxSettings(required=("UMI",), most_distance=1) and found.matrix == MatrixSettings()
    assert found.ensemble == EnsembleSettings(method="voting", calibration="platt")
    assert AllSettings.read(found.write()).ensemble == found.ensemble
    with pytest.raises(ValueError):
        AllSettings.load(str(tmp_path / "s.toml"))


@pytest.mark.parametrize(
    "values",
    [
        {"demux": {"least_macth": 0.5}},
        {"training": {}},
        {"demux": {"least_match": 1.5}},
        {"demux": {"scores": "other"}},
        {"demux": {"required": ["X9"]}},
        {"matrix": {"temperature": 0}},
        {"lengths": {"bounds": {"UMI": [9, 8]}}},
        {"ensemble": {"method": "best"}},
        {"ensemble": {"prior": "adaptive"}},
        {"ensemble": {"level": "high"}},
        {"ensemble": {"method": "stacking", "variance": True}},
        {"ensemble": []},
    ],
)
def test_what_is_refused(values):
    with pytest.raises(ValueError):
        AllSettings.of(values)


def test_lengths_are_checked_by_label():
    assert LengthSettings.of({"bounds": {"UMI": [8, 9]}}).bounds == {"UMI": [8, 9]}


@pytest.mark.parametrize("settings", [{"calibration": "isotonic", "variance": True, "intervals": True, "draws": 20}, {"method": "weighted_average", "calibration": "temperature"}, {"method": "stacking", "folds": 2, "calibration": "platt"}])
def test_the_whole_path(spark, sf, tmp_path, settings):
    p, t = inputs.predictions(spark, sf).filter("read_id < 40"), inputs.truth(spark, sf).filter("read_id < 40")
    found = ensembles.combine_models(p, t, p, EnsembleSettings.of(settings), labels=[0, 1, 2, 3])
    ensembles.write(found, str(tmp_path))
    places = p.select("read_id", "pos").distinct().count()
    assert spark.read.parquet(str(tmp_path / "predictions")).count() == places == spark.read.parquet(str(tmp_path / "uncertainty")).count()
    sums = found.probabilities.groupBy("read_id", "pos").agg(F.sum("p").alias("p"))
    assert sums.filter("abs(p - 1) > 1e-6").count() == 0
    assert (tmp_path / "variance").exists() == bool(settings.get("variance"))
