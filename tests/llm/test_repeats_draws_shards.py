"""Operators 11 to 13 against plain restatements."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readloom.llm import histogram_shards, periodic_runs, queries, target_resampling
from tests.llm import brute


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- 11 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("least_length, exponent", [(6, 4), (2, 2), (3, 3), (6, 2)])
def test_runs_equal_brute_force(least_length, exponent):
    rng = random.Random(11)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            n = rng.randint(0, 60)
            words = [str(rng.randint(1, rng.choice([1, 2, 3, 9]))) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                words = [words[i] if i < a else words[min(n - 1, a + (i - a) % p)] for i in range(n)]
            texts.append(" ".join(words))
        runs, left = periodic_runs.runs_of([t.encode() for t in texts], least_length, exponent)
        for text, found, rest in zip(texts, runs, left):
            want = brute.runs(text.split(), least_length, exponent)
            assert [tuple(r) for r in found.tolist()] == want
            assert rest.decode() == " ".join(brute.without_repeats(text.split(), want))


def test_refinement_moves_each_position_seldom():
    words = np.array([*(np.arange(20_000) % 3), 3])
    state = periodic_runs.Refinement(words, np.full(len(words), 5_000), np.zeros(len(words), np.int64))
    moved = 0
    while len(state.fresh):
        state.refine()
        moved += len(state.fresh)
    assert moved < len(words) * math.log2(len(words))


def test_runs_query_equals_brute_force(spark, sf):
    want = {}
    for r in documents(spark, sf).select("doc_id", "text").collect():
        words = brute.planted(r["text"], r["doc_id"])
        found = brute.runs(words, 6, 4)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        lines = "".join(f"{a},{n},{p}\n" for a, n, p in found)
        rest = " ".join(brute.without_repeats(words, found))
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, rest)]
        want[r["doc_id"]] = (len(found), *best, 1000 * best[1] // best[2] if found else None, *sha)
    columns = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    got = {r["doc_id"]: tuple(r[c] for c in columns) for r in queries.op11_periodic_runs(spark, sf).collect()}
    assert got == want and sum(v[0] for v in want.values()) > 5


def test_runs_take_odd_rows(spark, odd_docs, empty_docs):
    df = odd_docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.repeat(F.lit(" x y"), 9))).otherwise(F.col("text")))
    df = df.withColumn("runs", F.lit("mine"))
    for batch in (1, periodic_runs.BATCH):
        found = periodic_runs.with_runs(df, batch=batch)
        assert found.columns == [*odd_docs.columns, "runs", "collapsed"] and found.count() == df.count()
        for r in found.select("text", "runs", "collapsed").collect():
            words = brute.SPACED.findall(r["text"] or "")
            want = brute.runs(words, 6, 4)
            assert [tuple(x) for x in r["runs"]] == want and r["collapsed"] == " ".join(brute.without_repeats(words, want))
    assert periodic_runs.with_runs(empty_docs).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.with_runs(odd_docs, least_exponent=1)


# --- 12 -----------------------------------------------------------------------------------------------


def resampled(rows, items, n, buckets, least, percent, seed=7):
    def grams(text):
        words = brute.WORDS.findall(brute.lower(text))
        return len(words), [zlib.crc32(" ".join(words[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(words) - m + 1)]

    mine, theirs = [grams(t) for _, t in rows], [grams(t)[1] for t in items]
    s, t = Counter(x for _, g in mine for x in g), Counter(x for g in theirs for x in g)
    s_all, t_all = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * s_all / ((s[b] + 1) * t_all))) for b in s}
    out = []
    for (i, _), (words, g) in zip(rows, mine):
        weight = sum(gain[b] for b in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(g), weight, score, words))
    fit = sorted((-r[3], r[0], k) for k, r in enumerate(out) if r[4] >= least and r[0] is not None)
    rank = {k: place for place, (*_, k) in enumerate(fit[: percent * len(fit) // 100], 1)}
    return [(*r[:4], rank.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("n, buckets, percent", [(2, 10_000, 25), (1, 97, 60), (3, 70_000, 100)])
def test_resampling_equals_brute_force(spark, odd_docs, empty_docs, n, buckets, percent):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    items = ["the of and general license", None, "", "w1 w2 w3 w1 w2", "token token"]
    target = spark.createDataFrame([(t,) for t in items], "text string")
    found = target_resampling.resample(odd_docs, target, n=n, buckets=buckets, percent=percent)
    got = [tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = resampled(rows, items, n, buckets, 20, percent)
    assert sorted(got, key=str) == sorted(want, key=str)
    ranks = sorted(r[-1] for r in got if r[-1])
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    drawn = target_resampling.drawn(odd_docs, found)
    assert drawn.columns == odd_docs.columns and {r["doc_id"] for r in drawn.collect()} == {r[0] for r in got if r[-1]}
    assert target_resampling.resample(empty_docs, target, n=n).count() == 0
    assert target_resampling.resample(odd_docs, target.filter("false"), n=n).count() == len(rows)


def test_suffixes_are_sorted_and_share_what_they_share():
    rng = np.random.default_rng(12)
    words = rng.integers(0, 5, 400)
    for n in (1, 2, 4):
        order, shared = target_resampling.suffixes(words, n)
        heads = [tuple(words[i : i + n].tolist()) for i in order]
        assert sorted(order.tolist()) == list(range(400)) and heads == sorted(heads)
        for j in range(1, 400):
            common = next((k for k in range(n) if heads[j][k : k + 1] != heads[j - 1][k : k + 1]), n)
            assert shared[j] == min(common, n) or len(heads[j]) < n or len(heads[j - 1]) < n


# --- 13 -----------------------------------------------------------------------------------------------


def sharded(rows, shards):
    """Sorted (text, id, size, shard) by bytes before each row in the order of keys."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    keyed = sorted((md5(t or "") + md5("" if i is None else str(i)), i, len((t or "").encode()) + 8) for i, t in rows)
    total, before, out = sum(k[2] for k in keyed), 0, []
    for _, i, size in keyed:
        out.append((i, size, shards * before // total))
        before += size
    return out


@pytest.mark.parametrize("shards, piece", [(24, 8_192), (7, 4), (1, 1), (130, 2)])
def test_shards_equal_brute_force(spark, odd_docs, empty_docs, shards, piece):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.select("doc_id", "text").collect()]
    found = histogram_shards.shard(odd_docs, shards, carry=("text", "lang", "score"), piece=piece)
    assert found.columns == ["doc_id", "size", "text_crc32", "shard", "slot", "text", "lang", "score"]
    got = found.collect()
    assert sorted(((r["doc_id"], r["size"], r["shard"]) for r in got), key=str) == sorted(sharded(rows, shards), key=str)
    assert all(r["text_crc32"] == zlib.crc32((r["text"] or "").encode()) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert histogram_shards.shard(empty_docs, shards).count() == 0


def test_shards_of_copies_and_one_id(spark):
    """A third of all rows are one text, a third have one id, a third are equal in both."""
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, F.concat(F.lit("text "), F.col("id").cast("string"))).when(F.col("id") % 3 == 0, F.lit("copy" * 5)).otherwise(F.lit("same" * 7)).alias("text"),
    )
    got = histogram_shards.shard(df, 9, piece=16).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    sums = [sum(r["size"] for r in v) for v in by.values()]
    assert len(got) == 3_000 and len(by) == 9 and max(sums) - min(sums) <= 2 * 36
    assert all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())


def test_sharding_stays_with_built_in_functions(spark, sf):
    found = histogram_shards.shard(documents(spark, sf))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "ExistingRDD" not in plan and "Cartesian" not in plan


def test_shards_are_written_by_folder(spark, odd_docs, tmp_path):
    found = histogram_shards.shard(odd_docs, 3, carry=("text",))
    histogram_shards.write_shards(found, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").glob("shard=*")} == {f"shard={r['shard']}" for r in found.collect()}
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd_docs.count()
    with pytest.raises(ValueError):
        histogram_shards.shard(odd_docs, 0)
