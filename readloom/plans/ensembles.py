"""The whole path from models' predictions to calibrated labels with their doubts, as lazy tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import calibrate, combine, ensemble
from readloom.plans.settings import EnsembleSettings
from readloom.sources import sinks


@dataclass
class Combined:
    weights: DataFrame | None  # model, weight; none of a stacked ensemble
    probabilities: DataFrame  # read_id, pos, label, p
    labels: DataFrame  # read_id, pos, label, p, entropy
    uncertainty: DataFrame  # read_id, pos, entropy, disagreement, epistemic, aleatoric
    variance: DataFrame | None
    intervals: DataFrame | None


def combine_models(
    validation: DataFrame, truth: DataFrame, predictions: DataFrame, settings: EnsembleSettings = EnsembleSettings(), labels: list[int] | None = None
) -> Combined:
    """Weights and calibration are learnt from ``validation`` and ``truth``, and applied to ``predictions``.

    ``labels`` are needed for stacking. What calibrates is learnt from the combined probabilities of ``validation``.
    """
    s = settings
    weights = None
    if s.method == "stacking":
        if not labels:
            raise ValueError("stacking needs the labels")
        model = calibrate.fit_stack(validation, truth, labels, s.folds)
        known, found = calibrate.stacked(validation, model), calibrate.stacked(predictions, model)
    else:
        weights = combine.weights(
            validation, truth, s.method, s.parameters, s.prior, s.prior_weights, s.temperature, s.least_weight, s.fixed or None
        )
        known, found = ensemble.combined(validation, weights, s.average), ensemble.combined(predictions, weights, s.average)
    found = calibrate.calibrated(known, truth, found, s.calibration)
    best = F.max(F.struct(F.col("p").alias("p"), (-F.col("label")).alias("back"))).alias("x")
    entropy = -F.sum(F.col("p") * F.log(F.col("p") + ensemble.EPSILON))
    chosen = found.groupBy(*ensemble.PLACE).agg(best, entropy.alias("entropy"))
    chosen = chosen.select(*ensemble.PLACE, (-F.col("x.back")).cast("int").alias("label"), F.col("x.p").alias("p"), "entropy")
    return Combined(
        weights,
        found,
        chosen,
        ensemble.uncertainty(predictions, found),
        ensemble.posterior_variance(predictions, weights) if s.variance else None,
        ensemble.intervals(predictions, weights, s.level, s.draws) if s.intervals else None,
    )


def write(result: Combined, path: str) -> None:
    """Labels and doubts as Parquet, weights as JSON lines, a folder each."""
    result.labels.write.mode("overwrite").parquet(f"{path}/predictions")
    result.uncertainty.write.mode("overwrite").parquet(f"{path}/uncertainty")
    if result.weights is not None:
        sinks.write_jsonl(result.weights, f"{path}/weights", compress=False)
    for name, table in (("variance", result.variance), ("intervals", result.intervals)):
        if table is not None:
            table.write.mode("overwrite").parquet(f"{path}/{name}")
