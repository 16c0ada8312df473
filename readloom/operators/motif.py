"""Position weight matrices: estimation, scores, scans, entropies, divergences, diversity, sampling.

A matrix is a long table (pos, base, prob), pos from 0. It has a few dozen rows whatever the data, so it is
turned into literals and scores are plain expressions: no join and no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from readloom.functions.draws import uniform
from readloom.functions.seq import gc_content, let, letters
from readloom.schema import IUPAC, PWM

EPSILON = 1e-10
BASES = "ACGT"
Matrix = Sequence[Mapping[str, float]]


def matrix(pwm: DataFrame, most: int = 10_000) -> Matrix:
    """The table as one mapping a position; a matrix longer than ``most`` cells is refused."""
    rows = pwm.filter(F.col("base").isin(*BASES)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a position weight matrix of over {most} cells")
    out = [dict.fromkeys(BASES, 0.0) for _ in range(max((r["pos"] for r in rows), default=-1) + 1)]
    for r in rows:
        out[r["pos"]][r["base"]] = r["prob"]
    return out


def table(spark: SparkSession, m: Matrix) -> DataFrame:
    return spark.createDataFrame([(i, b, float(p.get(b, 0.0))) for i, p in enumerate(m) for b in BASES], PWM)


def from_pattern(pattern: str = "ACCSSV", pseudocount: float = 0.1) -> Matrix:
    return [
        {b: ((1 / len(IUPAC[c]) if b in IUPAC[c] else 0.0) + pseudocount) / (1 + 4 * pseudocount) for b in BASES}
        for c in pattern.upper()
    ]


def log_odds(m: Matrix) -> list[dict[str, float]]:
    return [{b: math.log(p[b] + EPSILON) - math.log(0.25) for b in BASES} for p in m]


def _codes(seq: Column) -> Column:
    """0 to 3 for A, C, G, T, 4 for anything else."""
    return F.transform(letters(F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "N"), BASES + "N", "01234")), lambda c: c.cast("int"))


def _cells(values: Sequence[Mapping[str, float]]) -> Column:
    return F.array(*[F.create_map(*[F.lit(x) for b in BASES for x in (b, float(v[b]))]) for v in values])


def _sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)


def _window(codes: Column, at: Column, m: Matrix) -> Column:
    """The score of the window of a code array that starts at ``at``: one array access a position."""
    odds = log_odds(m)
    low, high = sum(min(o.values()) for o in odds), sum(max(o.values()) for o in odds)
    own = [F.get(codes, at + k) for k in range(len(m))]
    total, known = F.lit(0.0), F.lit(False)
    for c, o in zip(own, odds):
        total = total + F.get(F.array(*[F.lit(o[b]) for b in BASES], F.lit(0.0)), c)
        known = known | (c < 4)
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (total - low) / (high - low if high > low else 1.0)))
    return F.when(known, scaled).otherwise(0.0)


def score(seq: Column, m: Matrix) -> Column:
    """Log-odds of the bases, scaled to [0, 1] by the best and worst motif; null for another length, 0 without a base."""
    return F.when(F.length(seq) == len(m), let(_codes(seq), lambda codes: _window(codes, F.lit(0), m)))


def best_match(seq: Column, m: Matrix, start: Column | int = 0, end: Column | None = None) -> Column:
    """struct(score, pos, motif): the first window with the highest score; (0, -1, '') if none scores above 0."""
    n = len(m)
    first = start if isinstance(start, Column) else F.lit(start)
    stop = F.length(seq) - n + 1
    stop = stop if end is None else F.least(end, stop)
    places = F.when(stop > first, F.sequence(first, stop - 1)).otherwise(F.array().cast("array<int>"))
    found = let(_codes(seq), lambda codes: F.transform(places, lambda i: F.struct(_window(codes, i, m).alias("score"), (-i).alias("back"))))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("pos"), F.lit("").alias("motif"))

    def shown(best: Column) -> Column:
        pos = -best["back"]
        hit = F.struct(best["score"].alias("score"), pos.alias("pos"), F.substring(seq, pos + 1, F.lit(n)).alias("motif"))
        return F.when(best["score"] > 0, hit).otherwise(none)

    return let(F.array_max(found), shown)


def detected(best: Column, least: float = 0.7) -> Column:
    """Whether a best match counts as the motif: there is one, and its score reaches ``least``."""
    return F.coalesce((best["pos"] >= 0) & (best["score"] >= least), F.lit(False))


def probabilities(seq: Column, m: Matrix) -> Column:
    """struct of log_likelihood, mean, least, geometric_mean and weighted (by the positions' entropy).

    Over the places with a base; the geometric mean's root is the motif's length. Null for another length.
    """
    weights = [-sum(x * math.log(x + EPSILON) for x in q.values()) / math.log(4) for q in m]
    cells = F.array(
        *[F.create_map(*[x for b in BASES for x in (F.lit(b), F.struct(F.lit(float(q[b])).alias("p"), F.lit(w).alias("w")))]) for q, w in zip(m, weights)]
    )
    found = F.transform(letters(F.upper(seq)), lambda c, i: F.try_element_at(F.try_element_at(cells, i + 1), c))
    known = F.filter(found, lambda x: x.isNotNull())
    p, n = F.transform(known, lambda x: x["p"]), F.size(known)
    geometric = F.when(F.array_min(p) == 0, 0.0).otherwise(F.exp(_sum(F.transform(p, lambda x: F.log(x))) / len(m)))
    fields = F.struct(
        _sum(F.transform(p, lambda x: F.log(x + EPSILON))).alias("log_likelihood"),
        F.coalesce(F.try_divide(_sum(p), n), F.lit(0.0)).alias("mean"),
        F.coalesce(F.array_min(p), F.lit(0.0)).alias("least"),
        F.coalesce(geometric, F.lit(1.0)).alias("geometric_mean"),
        F.coalesce(F.try_divide(_sum(F.transform(known, lambda x: x["p"] * x["w"])), n), F.lit(0.0)).alias("weighted"),
    )
    return F.when(F.length(seq) == len(m), fields)


# --- tables of sequences ----------------------------------------------------------------------------


def placed(seqs: DataFrame, col: str = "sequence") -> DataFrame:
    """(pos, base) of every sequence."""
    return seqs.select(F.posexplode(letters(F.upper(F.col(col)))).alias("pos", "base"))


def frequencies(seqs: DataFrame, col: str = "sequence") -> DataFrame:
    """(pos, base, n, freq): counted map-side, so what is shuffled is four rows a position and task."""
    n = placed(seqs, col).filter(F.col("base").isin(*BASES)).groupBy("pos", "base").agg(F.count("*").alias("n"))
    return n.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("pos")))


def entropies(freqs: DataFrame) -> DataFrame:
    """(pos, entropy) in [0, 1]: divided by that of four equal bases."""
    h = F.sum(-F.col("freq") * F.log(F.col("freq") + EPSILON)) / math.log(4)
    return freqs.groupBy("pos").agg(h.alias("entropy"))


def estimate(seqs: DataFrame, col: str = "sequence", pseudocount: float = 1.0) -> DataFrame:
    """(pos, base, prob) from sequences, every base of every position counted ``pseudocount`` times more."""
    n = frequencies(seqs, col).select("pos", "base", "n")
    grid = n.select("pos").distinct().withColumn("base", F.explode(F.array(*map(F.lit, BASES))))
    full = grid.join(n, ["pos", "base"], "left").withColumn("x", F.coalesce("n", F.lit(0)) + pseudocount)
    return full.select("pos", "base", (F.col("x") / F.sum("x").over(Window.partitionBy("pos"))).alias("prob"))


def kl_divergence(observed: DataFrame, m: Matrix) -> DataFrame:
    """(pos, kl) of observed (pos, base, freq) against a matrix, both smoothed and normalised again."""
    spark = observed.sparkSession
    both = table(spark, m).join(observed.select("pos", "base", "freq"), ["pos", "base"], "left")
    p, q = F.coalesce("freq", F.lit(0.0)) + EPSILON, F.col("prob") + EPSILON
    own = Window.partitionBy("pos")
    shares = both.select("pos", (p / F.sum(p).over(own)).alias("p"), (q / F.sum(q).over(own)).alias("q"))
    return shares.groupBy("pos").agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def classifier_metrics(scored: DataFrame, threshold: float) -> DataFrame:
    """One row from (score, truth): counts, rates, F1, and mean and deviation of the scores of either kind."""
    hit, truth = F.col("score") >= threshold, F.col("truth")
    n = scored.agg(
        F.count_if(hit & truth).alias("tp"),
        F.count_if(hit & ~truth).alias("fp"),
        F.count_if(~hit & ~truth).alias("tn"),
        F.count_if(~hit & truth).alias("fn"),
        F.avg(F.when(truth, F.col("score"))).alias("true_mean"),
        F.stddev_pop(F.when(truth, F.col("score"))).alias("true_std"),
        F.avg(F.when(~truth, F.col("score"))).alias("false_mean"),
        F.stddev_pop(F.when(~truth, F.col("score"))).alias("false_std"),
    )

    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0))

    out = n.withColumns({"tpr": share("tp", "fn"), "fpr": share("fp", "tn"), "specificity": share("tn", "fp"), "precision": share("tp", "fp")})
    f1 = F.try_divide(2 * F.col("precision") * F.col("tpr"), F.col("precision") + F.col("tpr"))
    return out.withColumn("f1", F.coalesce(f1, F.lit(0.0)))


def mean_hamming(seqs: DataFrame, col: str = "sequence") -> DataFrame:
    """One row: the mean share of places at which two different rows differ, over all pairs, for sequences of one length.

    Two rows agree at a place for every pair with the same base there, so the mean over all pairs follows
    from the positions' counts: linear work, and no pair is ever made.
    """
    letters_ = seqs.select(F.posexplode(letters(F.col(col))).alias("pos", "base"))
    counts = letters_.groupBy("pos", "base").agg(F.count("*").cast("double").alias("n"))
    places = counts.groupBy("pos").agg(F.sum("n").alias("all"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    differ = 1 - F.try_divide(F.col("same"), F.col("all") * (F.col("all") - 1))
    return places.agg(F.coalesce(F.avg(differ), F.lit(0.0)).alias("mean_distance"))


def diversity(seqs: DataFrame, col: str = "sequence") -> DataFrame:
    """One row: mean, least and greatest position entropy, mean pairwise distance, and share of distinct sequences."""
    h = entropies(frequencies(seqs, col)).agg(
        F.avg("entropy").alias("mean_entropy"), F.min("entropy").alias("min_entropy"), F.max("entropy").alias("max_entropy")
    )
    unique = seqs.agg((F.count_distinct(col) / F.count(col)).alias("uniqueness"))
    return h.crossJoin(mean_hamming(seqs, col)).crossJoin(unique)  # one row each


def report(seqs: DataFrame, m: Matrix, col: str = "sequence") -> DataFrame:
    """One row on all motifs of a column: counts, lengths (of several most frequent ones the least), GC, diversity, scores and divergence."""
    n = F.length(col)
    lengths = seqs.groupBy(n.alias("n")).agg(F.count("*").alias("k"))
    mode = lengths.agg(F.min_by("n", F.struct(-F.col("k"), F.col("n"))).alias("mode_length"))
    base = seqs.select(n.alias("n"), gc_content(F.col(col)).alias("gc"), score(F.col(col), m).alias("score")).agg(
        F.count("*").alias("n"),
        F.avg("n").alias("mean_length"),
        F.stddev_pop("n").alias("std_length"),
        F.min("n").alias("min_length"),
        F.max("n").alias("max_length"),
        F.avg("gc").alias("mean_gc"),
        F.avg("score").alias("mean_score"),
    )
    kl = kl_divergence(frequencies(seqs, col), m).agg(F.sum("kl").alias("kl"))
    return base.crossJoin(mode).crossJoin(diversity(seqs, col)).crossJoin(kl)  # one row each


def top(seqs: DataFrame, k: int, col: str = "sequence") -> DataFrame:
    return seqs.groupBy(col).agg(F.count("*").alias("n")).orderBy(F.desc("n"), col).limit(k)


# --- sampling ---------------------------------------------------------------------------------------


def tempered(m: Matrix, temperature: float = 1.0, min_entropy: float = 0.1) -> Matrix:
    """Probabilities to the power 1/T, mixed with equal ones (by half at most) where their entropy is too low."""
    out = []
    for p in m:
        x = {b: math.exp(math.log(p[b] + EPSILON) / temperature) for b in BASES} if temperature != 1 else dict(p)
        total = sum(x.values())
        x = {b: v / total for b, v in x.items()}
        h = -sum(v * math.log(v + EPSILON) for v in x.values()) / math.log(4)
        if h < min_entropy:
            mix = min(0.5, (min_entropy - h) / max(EPSILON, 1 - h))
            x = {b: (1 - mix) * v + mix / 4 for b, v in x.items()}
        out.append(x)
    return out


def sample(m: Matrix, seed: int, row: Column) -> Column:
    """A motif drawn from the matrix: at each position the base whose cumulative share the draw falls into."""
    picked = []
    for i, p in enumerate(m):
        u, total, choice = uniform(seed, row, i), 0.0, None
        for b in BASES[:-1]:
            total += p[b]
            choice = F.when(u < total, b) if choice is None else choice.when(u < total, b)
        picked.append(choice.otherwise(BASES[-1]))
    return F.concat(*picked)


def sample_quality(motif: Column, m: Matrix) -> Column:
    """int(40 * p) of each base drawn."""
    cells = _cells(m)
    return F.transform(letters(motif), lambda c, i: F.floor(40 * F.try_element_at(F.try_element_at(cells, i + 1), c)).cast("int"))


def running_counts(steps: DataFrame, value: str, counts: Sequence[str], parts: int = 64) -> DataFrame:
    """``steps`` (distinct values and counts of them) with each count summed over all values up to the row's, ``{count}_upto``,
    and over all rows, ``{count}_all``.

    Values are dealt into ranges; each is summed up on its own, and the ranges before it, of which there are ``parts`` at
    most, are added to it. Null values come first, as in the order of a window.
    """
    borders = steps.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)]).alias("x")).first()["x"] or []
    below = F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(borders))]), lambda x: x < F.col(value)) if borders else None
    ranged = steps.withColumn("_part", F.when(F.col(value).isNull(), -1).otherwise(F.size(below) if borders else F.lit(0)))
    every = Window.partitionBy()  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).select(
        "_part",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}_before") for c in counts],
        *[F.sum(c).over(every).alias(f"{c}_all") for c in counts],
    )
    upto = Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    along = ranged.withColumns({f"_{c}_own": F.sum(c).over(upto) for c in counts}).join(F.broadcast(sums), "_part")
    sums_ = [(F.col(f"_{c}_own") + F.col(f"_{c}_before")).alias(f"{c}_upto") for c in counts]
    return along.select(*steps.columns, *sums_, *[f"{c}_all" for c in counts])


def cumulative(rows: DataFrame, value: str) -> DataFrame:
    """(value, n, share): every distinct value, its count, and the share of rows with a value up to it; nulls have no part."""
    steps = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return running_counts(steps, value, ("n",)).select(value, "n", (F.col("n_upto") / F.col("n_all")).alias("share"))


def ks_statistic(scored: DataFrame, group: str = "grp", value: str = "score", parts: int = 64) -> DataFrame:
    """One row: the largest gap between two groups' (false, true) cumulative distributions, and their sizes."""
    steps = scored.groupBy(value).agg(F.count_if(~F.col(group)).alias("a"), F.count_if(F.col(group)).alias("b"))
    along = running_counts(steps, value, ("a", "b"), parts)
    gap = F.abs(F.try_divide(F.col("a_upto"), "a_all") - F.try_divide(F.col("b_upto"), "b_all"))
    return along.select(gap.alias("gap"), "a", "b").agg(F.max("gap").alias("ks"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))


def ks_pvalue(ks: float, n_a: int, n_b: int, terms: int = 100) -> float:
    """The asymptotic probability of a gap as large, if both samples come from one distribution."""
    if not n_a or not n_b:
        return 1.0
    n = n_a * n_b / (n_a + n_b)
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * ks
    if x < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (i - 1) * math.exp(-2 * i * i * x * x) for i in range(1, terms))))
