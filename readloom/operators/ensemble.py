"""Ensembles: weights, combination, uncertainty, diversity and calibration of several models' predictions.

Predictions are long: (model, read_id, pos, label, p). All models of one place and label meet in one grouping;
normalisation over a place's labels is a second one, of one row a label.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readloom.functions.draws import pick
from readloom.functions.sizes import at_most

EPSILON = 1e-10
PLACE = ("read_id", "pos")
#: Models of an ensemble, at most; bounds every table with a row for each.
MOST_MODELS = 10_000
#: Rows of predictions that one task groups by place, about; some 100 bytes each while they are sorted.
TASK_ROWS = 1_000_000
#: Digits of combined probabilities: models added up in another order differ beyond them, so ties are ties in any order.
#: Three more are rounded first, so that halves of the last digit go one way.
DIGITS = 12
#: Numbers of all draws and models that are sent to every task.
MOST_DRAWN = 1_000_000


def evidences(predictions: DataFrame, truth: DataFrame, parameters: Mapping[str, int], factor: float = 1.0) -> DataFrame:
    """(model, log_likelihood, evidence): the log-likelihood of the truth less the BIC penalty; n counts reads."""
    right = predictions.join(truth.select(*PLACE, "label"), [*PLACE, "label"])
    spark = predictions.sparkSession
    sizes = spark.createDataFrame(list(parameters.items()), "model string, parameters long")
    sums = right.groupBy("model").agg(F.sum(F.log(F.col("p") + EPSILON)).alias("log_likelihood"), F.count_distinct("read_id").alias("reads"))
    penalty = F.lit(factor) * F.coalesce("parameters", F.lit(0)) / 2 * F.log("reads")
    return sums.join(F.broadcast(at_most(sizes, MOST_MODELS, "models")), "model", "left").select("model", "log_likelihood", (F.col("log_likelihood") - penalty).alias("evidence"))


def log_priors(models: DataFrame, kind: str = "uniform", weights: Mapping[str, float] | None = None) -> DataFrame:
    """(model, log_prior): uniform, informative (given weights, normalised) or adaptive (inverse of ``parameters``)."""
    every = Window.partitionBy()  # one row a model
    if kind == "informative" and weights:
        table = F.create_map(*[F.lit(x) for item in weights.items() for x in item])
        share = F.coalesce(F.try_element_at(table, F.col("model")), 1.0 / F.count("*").over(every)) / sum(weights.values())
    elif kind == "adaptive":
        share = (1.0 / F.col("parameters")) / F.sum(1.0 / F.col("parameters")).over(every)
    else:
        share = 1.0 / F.count("*").over(every)
    return models.select("model", F.log(share).alias("log_prior"))


def posterior_weights(scores: DataFrame, temperature: float = 1.0, least: float = 0.0) -> DataFrame:
    """(model, weight) from (model, evidence, log_prior): softmax, weights under ``least`` dropped, normalised again."""
    every = Window.partitionBy()
    x = F.col("evidence") / temperature + F.coalesce("log_prior", F.lit(0.0))
    shifted = scores.withColumn("x", x).withColumn("w", F.exp(F.col("x") - F.max("x").over(every)))
    share = shifted.withColumn("w", F.col("w") / F.sum("w").over(every))
    kept = share.withColumn("w", F.when(F.col("w") < least, 0.0).otherwise(F.col("w")))
    return kept.select("model", F.coalesce(F.try_divide(F.col("w"), F.sum("w").over(every)), F.lit(0.0)).alias("weight"))


def performance_weights(
    models: DataFrame, method: str = "accuracy", temperature: float = 1.0, bonus: Mapping[str, float] | None = None, least: float = 0.0
) -> DataFrame:
    """(model, weight) from (model, kind, accuracy, loss): a power of the accuracy or of the gap to the worst loss."""
    every = Window.partitionBy()
    finite = F.when(~F.isnan("loss") & (F.col("loss") < float("inf")), F.col("loss"))
    if method == "loss":
        w = F.coalesce(F.pow(F.max(finite).over(every) - finite, F.lit(temperature)), F.lit(0.0))
    else:
        w = F.pow("accuracy", F.lit(temperature)) if method == "accuracy" else F.lit(1.0)
    if bonus:
        table = F.create_map(*[F.lit(x) for item in bonus.items() for x in item])
        w = w * (1 + F.coalesce(F.try_element_at(table, F.col("kind")), F.lit(0.0)))
    floored = models.select("model", F.greatest(w, F.lit(least)).alias("w"))
    return floored.select("model", (F.col("w") / F.sum("w").over(every)).alias("weight"))


def _weighted(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    return predictions.join(F.broadcast(at_most(weights, MOST_MODELS, "models")), "model", "left").withColumn("w", F.coalesce("weight", F.lit(0.0)))


def _by_place(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted rows dealt by place to as many tasks as their number asks for, so that a task's share doesn't grow with them."""
    least = int(predictions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _weighted(predictions, weights).repartition(max(least, -(-predictions.count() // TASK_ROWS)), *PLACE)


def average(predictions: DataFrame, weights: DataFrame, by_confidence: bool = False) -> DataFrame:
    """(read_id, pos, label, p): weighted mean of probabilities, each model's optionally times its highest one.

    Here and below rows are dealt by place once; windows and groupings by place and more keep to that.
    """
    rows = _by_place(predictions, weights)
    if by_confidence:
        rows = rows.withColumn("w", F.col("w") * F.max("p").over(Window.partitionBy(*PLACE, "model")))
    sums = rows.groupBy(*PLACE, "label").agg(F.sum(F.col("w") * F.col("p")).alias("x"))
    own = Window.partitionBy(*PLACE)
    return sums.select(*PLACE, "label", (F.col("x") / (F.sum("x").over(own) + EPSILON)).alias("p"))


def logit_average(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """softmax over labels of the weighted sum of log-probabilities."""
    rows = _by_place(predictions, weights)
    sums = rows.groupBy(*PLACE, "label").agg(F.sum(F.col("w") * F.log(F.col("p") + EPSILON)).alias("x"))
    own = Window.partitionBy(*PLACE)
    powers = sums.withColumn("e", F.exp(F.col("x") - F.max("x").over(own)))
    return powers.select(*PLACE, "label", (F.col("e") / F.sum("e").over(own)).alias("p"))


def rank_average(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted mean of the labels' ranks within each model (equal ones share their mean rank), normalised."""
    own = Window.partitionBy(*PLACE, "model")
    rank = F.rank().over(own.orderBy("p")) + (F.count("*").over(Window.partitionBy(*PLACE, "model", "p")) - 1) / 2
    rows = _by_place(predictions, weights).withColumn("r", rank)
    sums = rows.groupBy(*PLACE, "label").agg(F.sum(F.col("w") * F.col("r")).alias("x"))
    place = Window.partitionBy(*PLACE)
    return sums.select(*PLACE, "label", F.try_divide(F.col("x"), F.sum("x").over(place)).alias("p"))


def winners(predictions: DataFrame, by: tuple[str, ...] = PLACE) -> DataFrame:
    """(by..., label, p): the most probable label, the lowest of equal ones; a grouped maximum, no sort."""
    best = predictions.groupBy(*by).agg(F.max(F.struct(F.col("p").alias("p"), (-F.col("label")).alias("back"))).alias("x"))
    return best.select(*by, (-F.col("x.back")).cast("int").alias("label"), F.col("x.p").alias("p"))


def majority_vote(predictions: DataFrame) -> DataFrame:
    """(read_id, pos, label, votes): the label that most models choose, the lowest of equal ones."""
    votes = winners(predictions, ("model", *PLACE)).groupBy(*PLACE, "label").agg(F.count("*").alias("votes"))
    best = votes.groupBy(*PLACE).agg(F.max(F.struct("votes", (-F.col("label")).alias("back"))).alias("x"))
    return best.select(*PLACE, (-F.col("x.back")).cast("int").alias("label"), F.col("x.votes").alias("votes"))


def _entropy(p: Column) -> Column:
    return -F.sum(p * F.log(p + EPSILON))


def uncertainty(predictions: DataFrame, combined: DataFrame) -> DataFrame:
    """(read_id, pos, entropy, disagreement, epistemic, aleatoric); the last is the mean entropy of the models at a place.

    Predictions are dealt by place once; groupings by label and by place both keep to that.
    """
    total = combined.groupBy(*PLACE).agg(_entropy(F.col("p")).alias("entropy"))
    cells = predictions.repartition(*PLACE).groupBy(*PLACE, "label")
    cells = cells.agg(F.stddev_pop("p").alias("s"), _entropy(F.col("p")).alias("h"), F.collect_set("model").alias("models"))
    n = F.size(F.array_distinct(F.flatten(F.collect_list("models"))))  # each list holds the few models only
    own = cells.groupBy(*PLACE).agg(F.avg("s").alias("disagreement"), (F.sum("h") / n).alias("aleatoric"))
    return total.join(own, [*PLACE]).withColumn("epistemic", F.col("entropy") - F.col("aleatoric"))


def posterior_variance(predictions: DataFrame, weights: DataFrame) -> DataFrame:
    """(read_id, pos, label, variance): the weighted variance of the models' probabilities around their weighted mean."""
    rows = _by_place(predictions, weights)
    w, total = F.col("w"), F.sum("w")
    mean = F.try_divide(F.sum(w * F.col("p")), total)
    square = F.try_divide(F.sum(w * F.col("p") * F.col("p")), total)
    return rows.groupBy(*PLACE, "label").agg(F.greatest(square - mean * mean, F.lit(0.0)).alias("variance"))


def predict(predictions: DataFrame, weights: DataFrame, method: str = "probability", temperature: float | None = None) -> DataFrame:
    """(read_id, pos, label, p, entropy) of the winning label: models combined by a method, cooled if asked for.

    method: ``probability``, ``confidence``, ``logit`` or ``rank``.
    """
    found = combined(predictions, weights, method).withColumn("p", F.round(F.round("p", DIGITS + 3), DIGITS))
    if temperature is not None:
        found = with_temperature(found, temperature)
    first = F.max(F.struct(F.col("p").alias("p"), (-F.col("label")).alias("back"))).alias("x")
    found = found.groupBy(*PLACE).agg(first, _entropy(F.col("p")).alias("entropy"))
    return found.select(*PLACE, (-F.col("x.back")).cast("int").alias("label"), F.col("x.p").alias("p"), "entropy")


def combined(predictions: DataFrame, weights: DataFrame, method: str = "probability") -> DataFrame:
    """(read_id, pos, label, p) by one of the averages."""
    ways = {
        "probability": lambda: average(predictions, weights),
        "confidence": lambda: average(predictions, weights, by_confidence=True),
        "logit": lambda: logit_average(predictions, weights),
        "rank": lambda: rank_average(predictions, weights),
    }
    if method not in ways:
        raise ValueError(f"no such method: {method}")
    return ways[method]()


def normalised(cells: DataFrame) -> DataFrame:
    """(read_id, pos, label, p) whose p add up to 1 at each place."""
    own = Window.partitionBy(*PLACE)
    return cells.select(*PLACE, "label", (F.col("p") / F.sum("p").over(own)).alias("p"))


def intervals(predictions: DataFrame, weights: DataFrame, level: float = 0.95, draws: int = 100, seed: int = 7) -> DataFrame:
    """(read_id, pos, label, low, high): percentiles of averages over models resampled with replacement.

    A draw says how often each model was picked: ``draws`` times models numbers, whatever the data. A place's
    models are brought together once; the draws are a product of matrices there.
    """
    models = sorted(r["model"] for r in at_most(weights, MOST_MODELS, "models").collect())
    if draws * len(models) > MOST_DRAWN:
        raise ValueError(f"more than {MOST_DRAWN} numbers of draws and models")
    spark = predictions.sparkSession
    picks = spark.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(len(models) - 1))).alias("slot"))
    counts = picks.groupBy("draw", pick(seed, len(models), F.col("draw"), F.col("slot")).alias("model")).agg(F.count("*").alias("times"))
    times = np.zeros((draws, len(models)), int)
    for r in counts.collect():
        times[r["draw"], r["model"]] = r["times"]
    at = F.array_position(F.array(*map(F.lit, models)), F.col("model")).cast("int")
    rows = _weighted(predictions, weights).withColumn("at", at).filter("at > 0")
    cells = rows.groupBy(*PLACE, "label").agg(F.collect_list(F.struct("at", "w", "p")).alias("cells"))
    kinds = [predictions.schema[c].dataType.simpleString() for c in (*PLACE, "label")]
    half, names = (1 - level) / 2, [*PLACE, "label"]
    drawn = times.T.astype(float)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cells")
            rows_ = np.repeat(np.arange(batch.num_rows), np.diff(cell.offsets.to_numpy()))
            flat = cell.flatten()
            at_, w, p = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("at", "w", "p"))
            sums, weight = np.zeros((batch.num_rows, len(models))), np.zeros((batch.num_rows, len(models)))
            np.add.at(sums, (rows_, at_ - 1), w * p)
            np.add.at(weight, (rows_, at_ - 1), w)
            total = weight @ drawn
            # a draw in which no model of the place was picked says nothing
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.where(total > 0, (sums @ drawn) / total, np.nan)
            low, high = np.full(len(x), np.nan), np.full(len(x), np.nan)
            gaps = np.isnan(x)
            for some, percentile in ((~gaps.any(axis=1), np.percentile), (gaps.any(axis=1) & ~gaps.all(axis=1), np.nanpercentile)):
                if some.any():
                    low[some], high[some] = percentile(x[some], [100 * half, 100 * (1 - half)], axis=1)
            columns = [batch.column(c) for c in names] + [pa.array(v, pa.float64(), from_pandas=True) for v in (low, high)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "low", "high"])

    fields = ", ".join(f"{c} {k}" for c, k in zip(names, kinds))
    return cells.mapInArrow(cut, f"{fields}, low double, high double")


def diversity(predictions: DataFrame, metric: str = "disagreement") -> DataFrame:
    """One row: the mean over pairs of models of their disagreement, summed KL divergence, or 1 - correlation.

    Pairs of models meet at one place, so the join's output is places times pairs of the few models.
    """
    if metric == "disagreement":
        rows = winners(predictions, ("model", *PLACE)).select("model", *PLACE, "label")
        keys = [*PLACE]
    else:
        rows, keys = predictions.select("model", *PLACE, "label", "p"), [*PLACE, "label"]
    other = rows.select(*keys, F.col("model").alias("model2"), F.col("p" if metric != "disagreement" else "label").alias("y"))
    pairs = rows.join(other, keys).filter(F.col("model") < F.col("model2")).groupBy("model", "model2")
    x = F.col("p")
    value = {
        "disagreement": F.avg((F.col("label") != F.col("y")).cast("double")) if metric == "disagreement" else None,
        "kl": F.sum(x * F.log((x + EPSILON) / (F.col("y") + EPSILON))) if metric == "kl" else None,
        "correlation": F.corr("p", "y") if metric == "correlation" else None,
    }[metric]
    mean = pairs.agg(value.alias("v")).agg(F.coalesce(F.avg("v"), F.lit(0.0)).alias("v"))
    return mean.select((1 - F.col("v") if metric == "correlation" else F.col("v")).alias("diversity"))


# --- calibration ------------------------------------------------------------------------------------


def calibration(chosen: DataFrame, bins: int = 10) -> DataFrame:
    """One row, ece, from (p, correct): bins are open below and closed above."""
    bin_ = F.greatest(F.lit(1), F.ceil(F.col("p") * bins))
    per = chosen.filter("p > 0").groupBy(bin_.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg(F.col("correct").cast("double")).alias("acc")
    )
    total = chosen.agg(F.count("*").alias("all"))
    gap = F.sum(F.abs(F.col("conf") - F.col("acc")) * F.col("n") / F.col("all"))
    return per.crossJoin(total).agg(F.coalesce(gap, F.lit(0.0)).alias("ece"))  # bins rows and one row


def brier(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: mean over places of the squared distance to the truth's one-hot vector."""
    both = predictions.join(truth.select(*PLACE, F.col("label").alias("truth")), [*PLACE])
    miss = F.pow(F.col("p") - F.when(F.col("label") == F.col("truth"), 1.0).otherwise(0.0), F.lit(2))
    return both.agg((F.sum(miss) / F.count_distinct(*PLACE)).alias("brier"))


def temperatures(predictions: DataFrame, truth: DataFrame, low: float = 0.1, high: float = 10.0, steps: int = 100) -> DataFrame:
    """(temperature, nll) over a grid of temperatures, in one pass over the data: a grid row costs a column, not a scan."""
    grid = [low * (high / low) ** (i / (steps - 1)) for i in range(steps)]
    both = predictions.join(truth.select(*PLACE, F.col("label").alias("truth")), [*PLACE])
    places = both.groupBy(*PLACE).agg(
        F.collect_list(F.log(F.col("p") + EPSILON)).alias("x"), F.max(F.when(F.col("label") == F.col("truth"), F.log(F.col("p") + EPSILON))).alias("own")
    )
    high_ = F.array_max("x")
    nll = [
        F.sum(F.log(F.aggregate("x", F.lit(0.0), lambda a, v: a + F.exp((v - high_) / t))) - (F.col("own") - high_) / t).alias(f"t{i}")
        for i, t in enumerate(grid)
    ]
    sums = places.agg(*nll)
    stacked = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.col(f"t{i}").alias("nll")) for i, t in enumerate(grid)]))
    return sums.select(stacked.alias("x")).select("x.*")


def with_temperature(predictions: DataFrame, temperature: float, by: tuple[str, ...] = PLACE) -> DataFrame:
    own = Window.partitionBy(*by)
    x = predictions.withColumn("_x", F.log(F.col("p") + EPSILON) / temperature)
    x = x.withColumn("_e", F.exp(F.col("_x") - F.max("_x").over(own)))
    return x.withColumn("p", F.col("_e") / F.sum("_e").over(own)).drop("_x", "_e")


def weight_grid(models: list[str], step: float = 0.1) -> list[dict[str, float]]:
    """Every mixture of up to three models whose weights are multiples of ``step`` and sum to one."""
    if len(models) > 3:
        raise ValueError("a grid is for three models at most")
    n = round(1 / step)

    def rest(k: int, left: int) -> list[list[int]]:
        return [[left]] if k == 1 else [[i, *r] for i in range(left + 1) for r in rest(k - 1, left - i)]

    return [dict(zip(models, [i / n for i in r])) for r in rest(len(models), n)]


def dirichlet_candidates(models: list[str], n: int = 100, seed: int = 7) -> list[dict[str, float]]:
    """n mixtures drawn evenly from all mixtures."""
    draws = np.random.default_rng(seed).dirichlet(np.ones(len(models)), n)
    return [dict(zip(models, map(float, row))) for row in draws]


def candidate_likelihoods(predictions: DataFrame, truth: DataFrame, candidates: list[dict[str, float]]) -> DataFrame:
    """(weights, log_likelihood) of every candidate mixture: one shuffle, a column for each candidate."""
    models = sorted(candidates[0])
    right = predictions.join(truth.select(*PLACE, "label"), [*PLACE, "label"])
    places = right.groupBy(*PLACE).agg(*[F.sum(F.when(F.col("model") == m, F.col("p"))).alias(f"p{i}") for i, m in enumerate(models)])

    def mixed(w: dict[str, float]) -> Column:
        return sum((F.coalesce(f"p{i}", F.lit(0.0)) * w[m] for i, m in enumerate(models)), F.lit(0.0))

    sums = places.agg(*[F.sum(F.log(mixed(w) + EPSILON)).alias(f"g{i}") for i, w in enumerate(candidates)])
    stacked = F.explode(
        F.array(*[F.struct(F.array(*[F.lit(w[m]) for m in models]).alias("weights"), F.col(f"g{i}").alias("log_likelihood")) for i, w in enumerate(candidates)])
    )
    return sums.select(stacked.alias("x")).select("x.*")


def best_weights(likelihoods: DataFrame) -> DataFrame:
    """One row: the weights with the highest likelihood, the first ones of equal."""
    best = F.max(F.struct("log_likelihood", F.transform("weights", lambda w: -w).alias("back"))).alias("x")
    return likelihoods.agg(best).select(F.transform("x.back", lambda w: -w).alias("weights"), "x.log_likelihood")


def agreement(predictions: DataFrame, first: str) -> DataFrame:
    """(model, same): whether a model chooses the same label as ``first`` at every place."""
    won = winners(predictions, ("model", *PLACE))
    base = won.filter(F.col("model") == first).select(*PLACE, F.col("label").alias("base"))
    return won.join(base, [*PLACE]).groupBy("model").agg(F.bool_and(F.col("label") == F.col("base")).alias("same"))
