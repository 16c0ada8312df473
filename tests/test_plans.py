from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readloom.plans import inputs
from readloom.plans.demultiplex import demultiplex, write
from readloom.plans.settings import DemuxSettings
from readloom.streaming import demux_stream

EXPECTED = tuple(name for name, _, _ in inputs.LAYOUT)


def labelled(spark, sf):
    reads = inputs.reads(spark, sf).withColumn("quality", F.repeat(F.lit("I"), 64))
    first = reads.filter("read_id < 5").select(F.col("read_id").alias("sheet_ordinal"), F.concat(F.lit("S"), F.col("read_id").cast("string")).alias("sample_name"), F.substring("sequence", 45, 8).alias("cbc"), F.substring("sequence", 53, 8).alias("i5"), F.substring("sequence", 1, 8).alias("i7"))
    return reads, first


def test_demultiplex(spark, sf, tmp_path):
    reads, sheet = labelled(spark, sf)
    settings = DemuxSettings(expected=EXPECTED, optional=())
    result = demultiplex(reads, sheet, settings)
    rows = {r["read_id"]: r for r in result.reads.select("read_id", "sample_name", "match", "classification").collect()}
    assert all(rows[i]["sample_name"] == f"S{i}" and rows[i]["match"] == "exact" for i in range(5))
    total = result.statistics.filter("sample_name is null").first()
    assert total["total"] == reads.count() and total["exact"] >= 5
    write(result, str(tmp_path / "out"), compress=False)
    assert spark.read.json(str(tmp_path / "out/annotations")).count() == reads.count()
    assert spark.read.text(str(tmp_path / "out/reads")).filter("sample = 'S3'").count() % 4 == 0


def test_low_confidence_is_invalid(spark, sf):
    reads, sheet = labelled(spark, sf)
    scored = reads.withColumn("scores", F.array_repeat(F.array(F.lit(0.6), F.lit(0.4)), 64))
    got = demultiplex(scored, sheet, DemuxSettings(expected=EXPECTED, optional=())).reads
    assert [r[0] for r in got.select("classification").distinct().collect()] == ["invalid"]


def test_settings():
    assert DemuxSettings.read(DemuxSettings(most_distance=1).write()) == DemuxSettings(most_distance=1)
    for bad in ({"most": 1}, {"least_match": 2}):
        with pytest.raises(ValueError):
            DemuxSettings.of(bad)


def test_streams(spark, sf, tmp_path):
    reads, sheet = inputs.coded(spark, sf), inputs.sheet(spark, sf)
    for i in range(2):
        reads.filter(F.col("read_id") % 2 == i).write.parquet(str(tmp_path / f"in/{i}"))
    schema = "read_id long, cbc string, i5 string, i7 string, classification string"
    stream = demux_stream.arriving(spark, str(tmp_path / "in/*"), schema, 1)
    q = demux_stream.assign_each_batch(stream, sheet, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    from readloom.operators import demux

    got = {(r["read_id"], r["sample_name"]) for r in spark.read.parquet(str(tmp_path / "out")).select("read_id", "sample_name").collect()}
    assert got == {(r["read_id"], r["sample_name"]) for r in demux.assign(reads, sheet).select("read_id", "sample_name").collect()}
    running = demux_stream.counts(demux_stream.arriving(spark, str(tmp_path / "in/*"), schema), sheet)
    q = running.writeStream.format("memory").queryName("running").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("running").agg(F.sum("total")).first()[0] == reads.count()
