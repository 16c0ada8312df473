"""One call for every way to combine models: how weights are chosen, and how predictions are brought together by them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readloom.operators import calibrate, ensemble

METHODS = ("bma", "weighted_average", "voting", "stacking")
#: Models that all mixtures in tenths are tried for; more than that get mixtures drawn at random.
GRID_MODELS = 3


def weights(
    predictions: DataFrame,
    truth: DataFrame,
    method: str = "bma",
    parameters: Mapping[str, int] | None = None,
    prior: str = "uniform",
    prior_weights: Mapping[str, float] | None = None,
    temperature: float = 1.0,
    least: float = 0.0,
    fixed: Mapping[str, float] | None = None,
    candidates: int = 100,
    seed: int = 7,
) -> DataFrame:
    """(model, weight) by a method, learnt from predictions whose truth is known.

    ``bma``: posterior weights from each model's likelihood, penalised by its number of ``parameters``. ``weighted_average``:
    ``fixed`` weights, made to add up to 1, or else the mixture under which the truth is likeliest: of up to three models among all in
    tenths, of more among ``candidates`` drawn ones. ``voting``: equal weights.
    """
    spark = predictions.sparkSession
    models = predictions.select("model").distinct()
    if method == "bma":
        found = ensemble.evidences(predictions, truth, parameters or {"": 0})
        given = models
        if prior == "adaptive":
            given = spark.createDataFrame(list((parameters or {}).items()), "model string, parameters long")
        priors = ensemble.log_priors(given, prior, prior_weights)
        return ensemble.posterior_weights(found.join(F.broadcast(priors), "model", "left"), temperature, least)
    if method == "voting":
        names = sorted(r["model"] for r in ensemble.at_most(models, ensemble.MOST_MODELS, "models").collect())
        return spark.createDataFrame([(m, 1 / len(names)) for m in names], "model string, weight double")
    if method == "weighted_average":
        if fixed:
            return spark.createDataFrame([(m, w / sum(fixed.values())) for m, w in sorted(fixed.items())], "model string, weight double")
        names = sorted(r["model"] for r in ensemble.at_most(models, ensemble.MOST_MODELS, "models").collect())
        tried = ensemble.weight_grid(names) if len(names) <= GRID_MODELS else ensemble.dirichlet_candidates(names, candidates, seed)
        best = ensemble.best_weights(ensemble.candidate_likelihoods(predictions, truth, tried)).first()
        return spark.createDataFrame(list(zip(names, best["weights"])), "model string, weight double")
    raise ValueError(f"no such method: {method}")


def predict(
    validation: DataFrame,
    predictions: DataFrame,
    truth: DataFrame,
    method: str = "bma",
    average: str = "probability",
    labels: list[int] | None = None,
    folds: int = 5,
    **options,
) -> DataFrame:
    """(read_id, pos, label, p): ``predictions`` combined by what ``validation`` and ``truth`` teach.

    ``average``: probability, confidence, logit or rank, for all methods but ``stacking``, which needs ``labels`` and scores every read with a
    model that didn't see it.
    """
    if method == "stacking":
        if not labels:
            raise ValueError("stacking needs the labels")
        return calibrate.stacked(predictions, calibrate.fit_stack(validation, truth, labels, folds, **options))
    return ensemble.combined(predictions, weights(validation, truth, method, **options), average)
