from __future__ import annotations

from readloom import queries


def test_calibrated_probabilities_rise_with_the_given_ones(spark, sf):
    given = {(r["read_id"], r["pos"]): r["p"] for r in queries._hits(spark, sf).collect()}
    for name in ("platt_calibrated", "isotonic_calibrated"):
        found = {(r["read_id"], r["pos"]): r["p"] for r in queries.queries()[name](spark, sf).collect()}
        assert set(found) == set(given) and all(0 <= p <= 1 for p in found.values())
        order = sorted(given, key=given.get)
        calibrated = [found[k] for k in order]
        rises = all(a <= b + 1e-9 for a, b in zip(calibrated, calibrated[1:]))
        falls = all(a >= b - 1e-9 for a, b in zip(calibrated, calibrated[1:]))
        assert rises or (name == "platt_calibrated" and falls)


def test_sampled_barcodes_come_from_the_sheet(spark, sf):
    from readloom.plans import inputs

    known = {r["cbc"] for r in inputs.sheet(spark, sf).collect()}
    drawn = [r["cbc"] for r in queries.queries()["whitelist_sampling"](spark, sf).collect()]
    assert set(drawn) <= known and None not in drawn


def pooled(rows):
    """Means of neighbours, pooled until they rise; equal p are one."""
    blocks = []
    for p in sorted({p for p, _ in rows}):
        own = [h for q, h in rows if q == p]
        blocks.append([sum(own), len(own), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2] + ps]
    return {p: s / n for s, n, ps in blocks for p in ps}


def test_isotonic_by_label_equals_pooled_neighbours(spark):
    import random

    from readloom.operators import calibrate

    rng = random.Random(5)
    rows, truth = [], []
    for i in range(150):
        w = [rng.randint(1, 9) for _ in range(3)]
        rows += [(i, 0, k, w[k] / sum(w)) for k in range(3)]
        truth.append((i, 0, rng.choices(range(3), w)[0]))
    own = {i: t for i, _, t in truth}
    steps = [pooled([(p, float(own[i] == k)) for i, _, c, p in rows if c == k]) for k in range(3)]
    given = spark.createDataFrame(rows, "read_id long, pos int, label int, p double")
    found = calibrate.calibrate_labels(given, spark.createDataFrame(truth, "read_id long, pos int, label int"))
    got = {(r["read_id"], r["label"]): r["p"] for r in found.collect()}
    assert len(got) == len(rows)
    for i in range(150):
        want = [steps[k][p] for j, _, k, p in rows if j == i]
        want = [x / sum(want) if sum(want) else 1 / 3 for x in want]
        assert all(abs(got[i, k] - want[k]) < 1e-9 for k in range(3))


def test_platt_leaves_no_gradient(spark, sf):
    """At the maximum of the likelihood residuals add up to nothing, alone and weighted by the log-odds."""
    import math

    given = {(r["read_id"], r["pos"]): (r["p"], r["hit"]) for r in queries._hits(spark, sf).collect()}
    found = {(r["read_id"], r["pos"]): r["p"] for r in queries.queries()["platt_calibrated"](spark, sf).collect()}
    rest = [(found[k] - given[k][1], math.log(given[k][0] / (1 - given[k][0]))) for k in given]
    assert abs(sum(r for r, _ in rest)) / len(rest) < 1e-3
    assert abs(sum(r * x for r, x in rest)) / len(rest) < 1e-3


def test_stacked_is_right_on_average(spark, sf):
    """Reads are scored by models that didn't see them, so the labels' shares are met but for chance (tests/test_fits.py has the gradients)."""
    from readloom.plans import inputs

    truth = {(r["read_id"], r["pos"]): r["label"] for r in inputs.truth(spark, sf).collect()}
    rest, sums = {}, {}
    for r in queries.queries()["stacked"](spark, sf).collect():
        place = r["read_id"], r["pos"]
        rest[r["label"]] = rest.get(r["label"], 0) + r["p"] - (truth[place] == r["label"])
        sums[place] = sums.get(place, 0) + r["p"]
    assert set(sums) == set(truth) and all(abs(s - 1) < 1e-6 for s in sums.values())
    assert all(abs(x) / len(truth) < 0.02 for x in rest.values())
