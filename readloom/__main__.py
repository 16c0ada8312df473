"""python -m readloom: demultiplexing, sheet checks, statistics and generation from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from readloom.operators import demux, ensemble, evaluate, simulate
from readloom.plans import ensembles
from readloom.plans.demultiplex import demultiplex, write
from readloom.plans.settings import AllSettings, DemuxSettings
from readloom.queries import LAYOUT
from readloom.sources import sinks, tables


def _settings(path: str | None) -> AllSettings:
    """A file with a section for each plan, or with the settings of demultiplexing alone."""
    if not path:
        return AllSettings()
    try:
        return AllSettings.load(path)
    except ValueError as problem:
        if "unknown settings" not in str(problem):
            raise
        return AllSettings(demux=DemuxSettings.load(path))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="readloom", description=__doc__)
    verbs = parser.add_subparsers(dest="verb", required=True)
    verb = verbs.add_parser("demux", help="reads (Parquet: read_id, sequence, labels) to samples")
    verb.add_argument("reads")
    verb.add_argument("sheet")
    verb.add_argument("out")
    verb.add_argument("--settings", help="JSON or YAML file")
    verb = verbs.add_parser("check-sheet", help="rules that a sample sheet breaks")
    verb.add_argument("sheet")
    verb = verbs.add_parser("stats", help="lengths and labels of reads")
    verb.add_argument("reads")
    verb = verbs.add_parser("evaluate", help="labels (Parquet: truth, label) to a report; without --out it is shown")
    verb.add_argument("pairs")
    verb.add_argument("--out")
    verb.add_argument("--metric", help="only this metric")
    verb.add_argument("--format", choices=("json", "csv", "parquet"), default="json")
    verb = verbs.add_parser("combine", help="models' predictions (Parquet: model, read_id, pos, label, p) to one label a place")
    verb.add_argument("predictions")
    verb.add_argument("weights", help="Parquet: model, weight")
    verb.add_argument("out")
    verb.add_argument("--method", choices=("probability", "confidence", "logit", "rank"), default="probability")
    verb.add_argument("--temperature", type=float)
    verb.add_argument("--variance", action="store_true")
    verb = verbs.add_parser("ensemble", help="as combine, with weights and calibration learnt from predictions whose truth is known")
    verb.add_argument("validation", help="Parquet: model, read_id, pos, label, probs (a probability for each label)")
    verb.add_argument("predictions", help="Parquet: model, read_id, pos, label, p")
    verb.add_argument("out")
    verb.add_argument("--settings", help="JSON or YAML file with a section ensemble")
    verb.add_argument("--labels", type=int, nargs="*")
    verb = verbs.add_parser("simulate", help="labelled reads")
    verb.add_argument("out")
    verb.add_argument("--reads", type=int, default=1000)
    verb.add_argument("--seed", type=int, default=42)
    verb.add_argument("--errors", type=float, default=0.0)
    verb.add_argument("--invalid", type=float, default=0.0)
    verb.add_argument("--format", choices=("parquet", "json", "text"), default="parquet")
    a = parser.parse_args(args)
    spark = SparkSession.builder.appName(f"readloom {a.verb}").getOrCreate()
    if a.verb == "demux":
        settings = _settings(a.settings).demux
        write(demultiplex(spark.read.parquet(a.reads), tables.read_samples(spark, a.sheet), settings), a.out)
    elif a.verb == "check-sheet":
        demux.sheet_issues(tables.read_samples(spark, a.sheet)).show(100, truncate=False)
    elif a.verb == "stats":
        reads = spark.read.parquet(a.reads)
        evaluate.length_statistics(reads.select(F.length("sequence").alias("n"))).show()
        evaluate.distribution(reads.select(F.explode("labels").alias("label")), "label").orderBy(F.desc("n")).show(50)
    elif a.verb == "evaluate":
        found = evaluate.report(spark.read.parquet(a.pairs))
        if a.metric:
            found = found.filter(F.col("metric") == a.metric)
        if a.out:
            sinks.write_report(found, a.out, a.format)
        else:
            found.orderBy("segment", "metric").show(200, truncate=False)
    elif a.verb == "combine":
        predictions, weights = spark.read.parquet(a.predictions), spark.read.parquet(a.weights)
        ensemble.predict(predictions, weights, a.method, a.temperature).write.mode("overwrite").parquet(f"{a.out}/predictions")
        if a.variance:
            ensemble.posterior_variance(predictions, weights).write.mode("overwrite").parquet(f"{a.out}/variance")
    elif a.verb == "ensemble":
        known, truth = tables.read_validation(spark, a.validation)
        ensembles.write(ensembles.combine_models(known, truth, spark.read.parquet(a.predictions), _settings(a.settings).ensemble, a.labels), a.out)
    else:
        reads = simulate.generate(spark, a.reads, LAYOUT, a.seed, a.errors)
        sinks.write_reads(simulate.corrupt(reads, a.seed, a.invalid) if a.invalid else reads, a.out, a.format)


if __name__ == "__main__":
    main()
