"""Writers. Rows are built as columns and written by all tasks; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pwm_rows(pwm: DataFrame) -> DataFrame:
    return pwm.select((F.col("pos") + 1).alias("pos"), "base", "prob")


def write_pwm(pwm: DataFrame, path: str) -> None:
    pwm_rows(pwm).orderBy("pos", "base").write.mode("overwrite").csv(path, sep="\t", header=True)


def annotation_rows(reads: DataFrame) -> DataFrame:
    """(read_id, label, start, end, length): one row a run of reads with a ``segments`` array."""
    flat = reads.select("read_id", F.explode("segments").alias("s"))
    return flat.select("read_id", "s.label", "s.start", "s.end", (F.col("s.end") - F.col("s.start")).alias("length"))


def gff_rows(reads: DataFrame, source: str) -> DataFrame:
    """One GFF3 line a run: 1-based closed places, numbered within the read and label."""
    own = reads.select("read_id", F.explode(F.transform("segments", lambda s, i: F.struct(s.alias("s"), _number(F.col("segments"), s, i).alias("k")))).alias("x"))
    s = F.col("x.s")
    line = F.concat_ws(
        "\t",
        F.col("read_id").cast("string"),
        F.lit(source),
        s["label"],
        (s["start"] + 1).cast("string"),
        s["end"].cast("string"),
        F.lit("."),
        F.lit("+"),
        F.lit("."),
        F.concat(F.lit("ID="), s["label"], F.lit("_"), F.col("x.k").cast("string")),
    )
    return own.select("read_id", line.alias("value"))


def _number(runs, run, i):
    return F.size(F.filter(F.slice(runs, F.lit(1), i), lambda r: r["label"] == run["label"]))


def write_gff(reads: DataFrame, path: str, source: str) -> None:
    gff_rows(reads, source).select("value").write.mode("overwrite").text(path)


def json_rows(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def write_jsonl(rows: DataFrame, path: str, compress: bool = True) -> None:
    json_rows(rows).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)


def write_json_lists(rows: DataFrame, path: str) -> None:
    """Files that are one indented list each, of the rows that a task has; a task without rows writes an empty list."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = "["
        for batch in batches:
            for value in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([held])], ["value"])
                held = value + ","
        yield pa.RecordBatch.from_arrays([pa.array([held.removesuffix(",") if held != "[" else held, "]"])], ["value"])

    text = F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias("value")
    rows.select(text).mapInArrow(lists, "value string").write.mode("overwrite").option("compression", "none").text(path)


def labelled_rows(reads: DataFrame, metadata: list[str] | None = None) -> DataFrame:
    """sequence, labels joined by blanks and, if asked for, columns as JSON, separated by tabs."""
    parts = ["sequence", F.array_join("labels", " ")]
    if metadata:
        parts.append(F.to_json(F.struct(*metadata)))
    return reads.select(F.concat_ws("\t", *parts).alias("value"))


def write_reads(reads: DataFrame, path: str, kind: str = "parquet", compress: bool = True) -> None:
    """Parquet, JSON lines or labelled text."""
    if kind == "parquet":
        reads.write.mode("overwrite").parquet(path)
    elif kind == "json":
        write_jsonl(reads, path, compress)
    elif kind == "text":
        labelled_rows(reads).write.mode("overwrite").option("compression", "gzip" if compress else "none").text(path)
    else:
        raise ValueError(f"no such format: {kind}")


def preview(reads: DataFrame, k: int = 1000) -> DataFrame:
    """One row over the first k reads: counts and length statistics; ``preview_counts`` has types and labels."""
    head = reads.orderBy("read_id").limit(k)
    n = F.length("sequence")
    return head.agg(
        F.count("*").alias("reads"),
        F.count_if(F.coalesce("is_invalid", F.lit(False))).alias("invalid"),
        F.avg(n).alias("mean_length"),
        F.min(n).alias("shortest"),
        F.max(n).alias("longest"),
    )


def preview_counts(reads: DataFrame, k: int = 1000) -> DataFrame:
    """(kind, name, n) over the first k reads: how many have an error type, and how many places have a label."""
    head = reads.orderBy("read_id").limit(k)
    types = F.when(F.col("error_type").isNotNull(), F.array("error_type")).otherwise(F.array().cast("array<string>"))
    found = F.concat(
        F.transform(types, lambda x: F.struct(F.lit("error_type").alias("kind"), x.alias("name"))),
        F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.struct(F.lit("label").alias("kind"), x.alias("name"))),
    )
    return head.select(F.explode(found).alias("x")).groupBy("x.kind", "x.name").agg(F.count("*").alias("n"))


def write_report(report: DataFrame, path: str, kind: str = "json") -> None:
    """Rows of a report as JSON lines, as a table with a header, or as Parquet."""
    if kind == "json":
        write_jsonl(report, path, compress=False)
    elif kind == "csv":
        report.write.mode("overwrite").csv(path, header=True)
    elif kind == "parquet":
        report.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"no such format: {kind}")


def write_ensemble(weights: DataFrame, evidences: DataFrame, path: str, variance: DataFrame | None = None) -> None:
    """An ensemble's results in one folder: weights and evidences as JSON lines, variances, a row a place and label, as Parquet."""
    write_jsonl(weights, f"{path}/weights", compress=False)
    write_jsonl(evidences, f"{path}/evidences", compress=False)
    if variance is not None:
        variance.write.mode("overwrite").parquet(f"{path}/variance")
