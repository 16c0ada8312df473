"""The whole path from labelled reads to per-sample reads and statistics, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.functions.seq import confidence, reverse_complement
from readloom.operators import demux
from readloom.plans.settings import DemuxSettings
from readloom.sources import fastq, sinks


@dataclass
class Demultiplexed:
    reads: DataFrame
    statistics: DataFrame
    issues: DataFrame


def demultiplex(reads: DataFrame, sheet: DataFrame, settings: DemuxSettings = DemuxSettings()) -> Demultiplexed:
    """Reads have read_id, sequence, labels (an array) and, for confidences, scores (an array of arrays).

    Segments, validation, confidence and barcodes are one projection; only barcodes are joined, and
    statistics are one rollup. Persist ``reads`` if more than one of the three results is used.
    """
    s = settings
    found = demux.extract(reads)
    names = F.transform("segments", lambda x: x["label"])
    valid = demux.validate(names, s.expected, s.required, s.optional, s.least_match, s.reverse, s.strict)
    if "scores" in reads.columns:
        sure = confidence(F.col("scores"), F.length("sequence"), s.scores)
        found = found.withColumn("confidence", sure)
        valid = demux.threshold(valid, F.col("confidence"), s.least_confidence)
    found = found.withColumn("_v", valid).select("*", "_v.classification", "_v.orientation", "_v.issues").drop("_v")
    if s.turn_reverse:
        turned = {c: F.when(F.col("orientation") == "reverse", reverse_complement(F.col(c))).otherwise(F.col(c)) for c in ("cbc", "i5", "i7")}
        found = found.withColumns(turned)
    assigned = demux.assign(found, sheet, s.most_distance)
    # only valid reads belong to a sample
    assigned = assigned.withColumn("sample_name", F.when(F.col("classification") == "valid", F.col("sample_name")).otherwise("undetermined"))
    return Demultiplexed(assigned, demux.statistics(assigned), demux.issues(found))


def validate_fastq(spark: SparkSession, path: str, predictions: DataFrame, settings: DemuxSettings = DemuxSettings()) -> DataFrame:
    """Reads of FASTQ files with the labels predicted for them, and their validation, as one lazy plan.

    ``predictions``: read_id (as in the files) and labels, perhaps scores. A read without a prediction is invalid.
    """
    s = settings
    found = demux.extract(fastq.read_split(spark, path).join(predictions, "read_id", "left"))
    names = F.transform(F.coalesce("segments", F.array().cast(found.schema["segments"].dataType)), lambda x: x["label"])
    valid = demux.validate(names, s.expected, s.required, s.optional, s.least_match, s.reverse, s.strict)
    if "scores" in predictions.columns:
        valid = demux.threshold(valid, F.coalesce(confidence(F.col("scores"), F.length("sequence"), s.scores), F.lit(0.0)), s.least_confidence)
    return found.withColumn("_v", valid).select("*", "_v.classification", "_v.orientation", "_v.issues").drop("_v")


def write_validated(reads: DataFrame, path: str, valid: bool = True, invalid: bool = False) -> None:
    """Valid reads and, if asked for, the others (ambiguous ones too) as FASTQ, each in a folder of its own."""
    good = F.col("classification") == "valid"
    for wanted, rows, name in ((valid, good, "valid"), (invalid, ~good, "invalid")):
        if wanted:
            fastq.record_rows(reads.filter(rows)).write.mode("overwrite").text(f"{path}/{name}")


def write(result: Demultiplexed, path: str, compress: bool = True) -> None:
    """FASTQ by sample (reads with a quality), annotations as JSON lines, statistics as JSON."""
    reads = result.reads.persist()
    try:
        if "quality" in reads.columns:
            fastq.write_by_sample(reads, f"{path}/reads", compress)
        shown = reads.select("read_id", "segments", "classification", "orientation", "issues", "sample_name", "match", "distance", "cbc", "i5", "i7")
        sinks.write_jsonl(shown, f"{path}/annotations", compress)
        demux.statistics(reads).coalesce(1).write.mode("overwrite").json(f"{path}/statistics")  # a row a sample
    finally:
        reads.unpersist()
