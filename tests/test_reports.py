from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readloom import __main__ as command
from readloom.functions import seq
from readloom.operators import calibrate, evaluate
from readloom.plans import inputs
from readloom.plans.demultiplex import validate_fastq
from readloom.plans.settings import DemuxSettings
from readloom.sources import fastq, sinks


def test_report_of_no_pairs(spark):
    rows = evaluate.report(spark.createDataFrame([], "truth string, label string")).collect()
    assert {(r["segment"], r["metric"], r["value"]) for r in rows} == {(None, m, 0.0) for m in ("accuracy", "precision", "recall", "f1")}


def test_findings_name_what_falls_below(spark):
    given = spark.createDataFrame([("valid", 0.9), ("cut_1", 0.5), ("cut_2", 0.8)], "variant string, accuracy double")
    found = {(r["rule"], r["name"]) for r in evaluate.robustness_findings(given, 0.7, {"cut_2": 0.8, "other": 1.0}, {"cut": 0.75, "none": 1.0}).collect()}
    assert found == {("worst", "cut_1"), ("group", "cut")}
    assert evaluate.robustness_findings(given.filter("accuracy > 1"), groups={"cut": 1.0}).count() == 0


def test_unknown_formats_and_ways_are_refused(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, 0, 1.0)], "read_id long, pos int, label int, p double")
    with pytest.raises(ValueError):
        sinks.write_report(rows, str(tmp_path / "x"), "pickle")
    with pytest.raises(ValueError):
        calibrate.calibrate_labels(rows, rows.drop("p"), "other")


def test_preview_counts_of_reads_without_labels(spark):
    rows = spark.createDataFrame([(1, None, None), (2, ["A", "A"], "loss"), (3, [], None)], "read_id long, labels array<string>, error_type string")
    assert {tuple(r) for r in sinks.preview_counts(rows, 2).collect()} == {("label", "A", 2), ("error_type", "loss", 1)}
    assert {tuple(r) for r in sinks.preview_counts(rows, 1).collect()} == set()


def test_folded_lookup_without_values(spark):
    assert spark.range(1).select(seq.folded_lookup({"a": ""}, F.lit("a")).alias("x")).first()["x"] is None


def test_settings_of_yaml():
    pytest.importorskip("yaml")
    assert DemuxSettings.read_yaml("least_match: 0.5\nrequired: [CBC]\n") == DemuxSettings(least_match=0.5, required=("CBC",))
    assert DemuxSettings.read_yaml("") == DemuxSettings()
    with pytest.raises(ValueError):
        DemuxSettings.read_yaml("other: 1")


def test_fastq_reads_of_low_scores_or_none_are_invalid(spark, sf, tmp_path):
    reads = inputs.reads(spark, sf).orderBy("read_id").limit(6).select(F.col("read_id").cast("string").alias("read_id"), "sequence", "labels")
    fastq.record_rows(reads.withColumn("quality", F.repeat(F.lit("+"), 64))).coalesce(1).write.text(str(tmp_path / "in"))
    ids = sorted(r["read_id"] for r in reads.select("read_id").collect())
    sure = F.when(F.col("read_id") == ids[0], 0.5).otherwise(0.99)
    scored = reads.filter(F.col("read_id") != ids[1]).select("read_id", "labels", F.array_repeat(F.array(sure, 1 - sure), 64).alias("scores"))
    settings = DemuxSettings(expected=tuple(name for name, _, _ in inputs.LAYOUT), required=("CBC",), optional=())
    found = {r["read_id"]: r for r in validate_fastq(spark, str(tmp_path / "in"), scored, settings).collect()}
    assert {i for i in ids if found[i]["classification"] == "valid"} == set(ids[2:])
    assert found[ids[0]]["issues"] == ["low_confidence"] and "missing:CBC" in found[ids[1]]["issues"]
    assert all(r["quality"] == "+" * 64 for r in found.values())


def test_verbs(spark, sf, tmp_path, capsys):
    inputs.pairs(spark, sf).write.parquet(str(tmp_path / "pairs"))
    command.main(["evaluate", str(tmp_path / "pairs"), "--metric", "accuracy"])
    assert "accuracy" in capsys.readouterr().out
    command.main(["evaluate", str(tmp_path / "pairs"), "--out", str(tmp_path / "report"), "--format", "csv"])
    assert spark.read.csv(str(tmp_path / "report"), header=True).columns == ["segment", "metric", "value"]
    inputs.predictions(spark, sf).write.parquet(str(tmp_path / "predictions"))
    spark.createDataFrame([("m0", 0.5), ("m1", 0.5)], "model string, weight double").write.parquet(str(tmp_path / "weights"))
    command.main(["combine", str(tmp_path / "predictions"), str(tmp_path / "weights"), str(tmp_path / "out"), "--method", "logit", "--temperature", "1.5", "--variance"])
    places = inputs.truth(spark, sf).count()
    assert spark.read.parquet(str(tmp_path / "out/predictions")).count() == places
    assert spark.read.parquet(str(tmp_path / "out/variance")).count() == places * inputs.CLASSES
