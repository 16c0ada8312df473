from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pytest

from readloom import queries
from readloom.operators import decode


def value(path, scores, moves):
    return sum(scores[i, j] for i, j in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:]))


def allowed(path, bounds):
    return all(k not in bounds or bounds[k][0] <= len(list(g)) <= bounds[k][1] for k, g in itertools.groupby(path))


@pytest.mark.parametrize("seed", range(40))
def test_paths_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    t, k = int(rng.integers(1, 7)), 3
    scores, moves = rng.normal(size=(t, k)), rng.normal(size=(k, k))
    bounds = {0: (2, 3), 1: (1, 2)} if seed % 2 else {2: (1, 1)}
    every = list(itertools.product(range(k), repeat=t))
    best = max(value(p, scores, moves) for p in every)
    assert value(decode.viterbi(scores, moves), scores, moves) == pytest.approx(best)
    fits = [p for p in every if allowed(p, bounds)]
    got = decode.bounded_viterbi(scores, moves, bounds)
    if fits:
        assert allowed(got, bounds)
        assert value(got, scores, moves) == pytest.approx(max(value(p, scores, moves) for p in fits))
    else:
        assert got == decode.viterbi(scores, moves)
    total = np.log(sum(np.exp(value(p, scores, moves)) for p in every))
    assert decode.log_likelihood(scores, moves, list(every[0])) == pytest.approx(value(every[0], scores, moves) - total)


def test_empty_scores(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [[0.0, 1.0], [2.0, 1.0]])], "read_id long, scores array<array<double>>")
    got = {r["read_id"]: r["path"] for r in decode.decode(df, [[0.0, 0.0], [0.0, 0.0]]).collect()}
    assert got == {1: [], 2: [], 3: [1, 0]}


def test_path_scores_and_partition_equal_enumeration(spark):
    import itertools
    import math

    from pyspark.sql import functions as F

    from readloom.operators import decode

    moves = [[-0.2, -1.0, -2.0], [-1.5, -0.1, -0.7], [-0.3, -2.5, -0.4]]
    scores = [[0.5, -1.0, 2.0], [1.5, 0.0, -0.5], [-2.0, 0.3, 0.1], [0.0, 1.0, 0.9]]

    def total(path):
        return sum(scores[i][j] for i, j in enumerate(path)) + sum(moves[a][b] for a, b in zip(path, path[1:]))

    rows = spark.createDataFrame([(1, scores, [2, 0, 0, 1]), (2, scores[:1], [1]), (3, [], [])], "id int, scores array<array<double>>, path array<int>")
    out = {
        r[0]: r[1:]
        for r in rows.select("id", decode.path_score(F.col("scores"), F.col("path"), moves), decode.log_partition(F.col("scores"), moves)).collect()
    }
    every = [total(p) for p in itertools.product(range(3), repeat=4)]
    assert math.isclose(out[1][0], total([2, 0, 0, 1])) and math.isclose(out[1][1], math.log(sum(map(math.exp, every))))
    assert math.isclose(out[2][0], -1.0) and math.isclose(out[2][1], math.log(sum(map(math.exp, scores[0]))))
    assert out[3][0] == 0.0 and out[3][1] is None


@pytest.mark.parametrize("key, path", [("32746-m0", "22200222"), ("45369-m0", "22221000"), ("8621-m1", "22220011"), ("20468-m1", "33330033")])
def test_equal_sums_go_by_label_and_length(key, path):
    """Paths as good as each other whose sums differ in the last bits before a move and not after it, as the SQL has them."""
    w = np.array([1 + int(c, 16) for c in hashlib.md5(key.encode()).hexdigest()], float).reshape(8, 4)
    scores = np.round(np.log(w / w.sum(1, keepdims=True)), 9)
    assert "".join(map(str, decode.bounded_viterbi(scores, np.array(queries.MOVES), queries.RUN_BOUNDS))) == path
