"""Small text tables: matrices, priors, whitelists, sample sheets, labelled reads. Explicit schemas, no inference."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.schema import IUPAC
from readloom.sources import json_arrays


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines that aren't blank or comments; Windows line ends are taken off."""
    return spark.read.text(path).select(F.trim(F.translate("value", "\r", "")).alias("value")).filter("value <> '' AND value NOT LIKE '#%'")


def read_pwm(spark: SparkSession, path: str) -> DataFrame:
    """(pos, base, prob), pos from 0; other bases are skipped."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="pos int, base string, prob double")
    return rows.filter(F.upper("base").isin(*"ACGT")).select((F.col("pos") - 1).alias("pos"), F.upper("base").alias("base"), "prob")


def pwm_issues(pwm: DataFrame) -> DataFrame:
    """Positions whose probabilities don't add up to 1."""
    return pwm.groupBy("pos").agg(F.sum("prob").alias("total")).filter(F.abs(F.col("total") - 1) > 1e-5)


def read_priors(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(model_name, sequence, frequency), frequencies of a model adding up to 1; none if one isn't a number."""
    rows = _lines(spark, path).select(F.split("value", "\t").alias("x")).filter(F.get("x", F.lit(0)) != "model_name")
    rows = rows.select(F.get("x", F.lit(0)).alias("model_name"), F.get("x", F.lit(1)).alias("sequence"), F.get("x", F.lit(2)).try_cast("double").alias("frequency"))
    if model is not None:
        rows = rows.filter(F.col("model_name") == model)
    own = Window.partitionBy("model_name")
    bad = F.count_if(F.col("frequency").isNull()).over(own)
    total = F.sum("frequency").over(own)
    scaled = F.when(F.abs(total - 1) > 0.01, F.col("frequency") / total).otherwise(F.col("frequency"))
    return rows.withColumn("bad", bad).withColumn("frequency", scaled).filter("bad = 0").drop("bad")


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim(F.translate("value", "\r", "")).alias("barcode")).filter("barcode <> ''")


def read_whitelist(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq) of ``name<TAB>seq`` or bare lines; upper-case; others than IUPAC codes are dropped."""
    x = F.split("value", "\t")
    rows = _lines(spark, path).select(F.when(F.size(x) > 1, F.get(x, F.lit(0))).alias("name"), F.upper(F.trim(F.try_element_at(x, F.lit(-1)))).alias("seq"))
    return rows.filter(F.col("seq").rlike(f"^[{''.join(IUPAC)}]+$"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sheet_ordinal, sample_name, cbc, i5, i7); a sheet without one of these columns is refused."""
    rows = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.strip(): c for c in rows.columns}
    if missing := [c for c in ("sample_name", "cbc", "i5", "i7") if c not in names]:
        raise ValueError(f"the sample sheet has no column {', '.join(missing)}")
    codes = [F.upper(F.trim(F.col(names[c]))).alias(c) for c in ("cbc", "i5", "i7")]
    # a sheet is one small file, so ids grow in its order
    return rows.select(F.monotonically_increasing_id().alias("sheet_ordinal"), F.trim(F.col(names["sample_name"])).alias("sample_name"), *codes)


def read_orders(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A table whose list columns hold arrays, as JSON or with single quotes; they are parsed, never evaluated.

    A value that is neither is refused; a missing one is null.
    """
    rows = spark.read.csv(path, sep="\t", header=True)

    def parsed(c: str):
        found = F.coalesce(F.from_json(F.col(c), "array<string>"), F.from_json(F.translate(F.col(c), "'", '"'), "array<string>"))
        refused = F.raise_error(F.concat(F.lit(f"{c} is no list: "), F.left(F.col(c), F.lit(80)))).cast("array<string>")
        return F.when(F.trim(F.col(c)) == "", None).when(F.col(c).isNotNull() & found.isNull(), refused).otherwise(found)

    return rows.withColumns({c: parsed(c) for c in columns})


def read_validation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Predictions (model, read_id, pos, label, p) and truth (read_id, pos, label) of a Parquet table.

    Its rows are (model, read_id, pos, label, probs): the true label and an array with a probability for each label.
    """
    rows = spark.read.parquet(path)
    if missing := [c for c in ("model", "read_id", "pos", "label", "probs") if c not in rows.columns]:
        raise ValueError(f"the validation set has no column {', '.join(missing)}")
    predictions = rows.select("model", "read_id", "pos", F.posexplode("probs").alias("label", "p"))
    return predictions, rows.select("read_id", "pos", "label").distinct()


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(read_id, sequence, labels, metadata) of two or three tab-separated columns; labels by comma or blank."""
    x = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(x).isin(2, 3)).select(F.monotonically_increasing_id().alias("read_id"), x.alias("x"))
    return rows.select(
        "read_id",
        F.get("x", F.lit(0)).alias("sequence"),
        F.split(F.trim(F.get("x", F.lit(1))), "[, ]+").alias("labels"),
        F.from_json(F.get("x", F.lit(2)), "map<string,string>").alias("metadata"),
    )


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """Whole numbers, one a line; other lines are skipped."""
    return spark.read.text(path).select(F.trim("value").try_cast("int").alias("n")).filter("n is not null")


def read_labelled_json(spark: SparkSession, path: str, schema: str, wrapped: bool | None = None) -> DataFrame:
    """Labelled reads of JSON: lines with an object a read, or files that are one array of them, bare or as ``reads`` of an object.

    ``wrapped``: False for lines, True for arrays; unless it is given, the first file's first characters tell. Arrays may be laid out in any
    way and are read in parts. A read that isn't an object of JSON is refused.
    """
    if wrapped is None:
        head = spark.read.option("lineSep", "}").text(path).select(F.ltrim(F.regexp_replace(F.left("value", F.lit(4_096)), r"\s+", " ")).alias("h")).filter("h <> ''").first()
        wrapped = head is not None and bool(re.match(r'\[|\{ ?"(reads|metadata)" ?: ?[\[{]', head["h"])) and not _is_lines(spark, path)
    if not wrapped:
        return spark.read.json(path, schema=schema, mode="FAILFAST")
    parsed = F.from_json("value", schema, {"mode": "FAILFAST"})
    return json_arrays.elements(spark, path, "reads").select(parsed.alias("x")).select("x.*")


def _is_lines(spark: SparkSession, path: str) -> bool:
    """Whether the first line with text is an object of its own with a sequence."""
    line = spark.read.text(path).filter("trim(value) <> ''").select(F.left("value", F.lit(1 << 20)).alias("v")).first()
    try:
        found = json.loads(line["v"])
    except ValueError:
        return False
    return isinstance(found, dict) and "sequence" in found


def read_invalid(spark: SparkSession, path: str) -> DataFrame:
    """(sequence, labels, label_regions, metadata) of invalid reads, however they were written; regions are lists of (start, end)."""
    schema = "sequence string, labels array<string>, label_regions map<string, array<array<int>>>, metadata map<string, string>"
    return read_labelled_json(spark, path, schema)
