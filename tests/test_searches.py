"""Sequences by byte ranges, frequent values, filtered joins, merged sketches, keyed streams and the committing sink."""

from __future__ import annotations

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from readloom import sources
from readloom.operators import heavy, membership, quantiles
from readloom.sources import fasta, fastq, ranges
from readloom.streaming import stateful


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    sources.register(spark)


def genome(path, n=400, width=50, end="\n"):
    rng = random.Random(4)
    seqs = {f"c{i}": "".join(rng.choices("ACGT", k=rng.choice([1, 49, 50, 51, 2_000]))) for i in range(n)}
    text = "".join(f">{name} x{end}" + "".join(s[j : j + width] + end for j in range(0, len(s), width)) for name, s in seqs.items())
    path.write_bytes(text.encode())
    return seqs


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_only_wanted_bytes_are_read(spark, tmp_path, end):
    seqs = genome(tmp_path / "g.fa", end=end)
    records = fasta.read_split(spark, str(tmp_path / "g.fa"))
    lines = ["\t".join(str(r[c]) for c in ("name", "length", "offset", "line_bases", "line_width")) for r in fasta.index(records).collect()]
    (tmp_path / "g.fa.fai").write_text("\n".join([*lines, "broken\tline"]))
    assert fasta.find_index(spark, str(tmp_path / "g.fa")) == str(tmp_path / "g.fa.fai")
    wanted = ["c3", "c4", "c250", "c399", "none"]
    reader = ranges.RangeReader({"path": str(tmp_path / "g.fa"), "gap": "100"})
    list(reader.pushFilters([ranges.In(("name",), tuple(wanted)), ranges.EqualTo(("bytes",), 1)]))
    need = sum(len(seqs[w]) for w in wanted if w in seqs)
    assert need <= sum(p.bytes for p in reader.partitions()) <= 1.1 * need + 400
    found = spark.read.format("fasta_ranges").load(str(tmp_path / "g.fa")).filter(F.col("name").isin(wanted))
    assert {r["name"]: r["sequence"] for r in found.collect()} == {w: seqs[w] for w in wanted if w in seqs}
    assert spark.read.format("fasta_ranges").load(str(tmp_path / "g.fa")).count() == len(seqs)
    names = spark.createDataFrame([(w, i) for i, w in enumerate([*wanted, "c3", None])], "name string, i int")
    got = ranges.fetch_ranges(names, fasta.index(records, files=True)).collect()
    assert len(got) == 7 and all(r["sequence"] == seqs.get(r["name"]) for r in got)
    with pytest.raises(Exception, match="compressed"):
        spark.read.format("fasta_ranges").load(str(tmp_path / "g.fa.gz")).collect()


def test_index_names(spark, tmp_path):
    assert fasta.index_paths("/d/x.fa.gz") == ["/d/x.fa.gz.fai", "/d/x.fa.fai"]
    assert fasta.index_paths("x.fa") == ["x.fa.fai", "x.fai"]
    (tmp_path / "x.fai").write_text("")
    assert fasta.find_index(spark, str(tmp_path / "x.fa")) == str(tmp_path / "x.fai")
    assert fasta.find_index(spark, str(tmp_path / "y.fa")) is None


def test_frequent_values_are_exact(spark):
    """A million distinct values, some frequent: few counters, and far fewer rows shuffled than there are values."""
    rare = spark.range(1_000_000).select(F.col("id").cast("string").alias("v"))
    often = spark.range(200_000).select(F.concat(F.lit("often "), F.floor(F.sqrt(F.col("id") / 20)).cast("string")).alias("v"))
    rows = rare.union(often).union(spark.createDataFrame([(None,)] * 5, "v string")).repartition(8, F.rand(3))
    want = [tuple(r) for r in rows.filter("v is not null").groupBy("v").count().orderBy(F.desc("count"), "v").limit(25).collect()]
    assert [tuple(r) for r in heavy.most_frequent(rows, "v", 25, counters=1_000).collect()] == want
    sent = heavy.summaries(rows, "v", 1_000).count()
    assert sent <= 8 * 2_001


@pytest.mark.parametrize("counters", [2, 50, 10_000])
def test_frequent_values_of_small_and_flat_tables(spark, counters):
    rng = random.Random(counters)
    rows = [(rng.choice([1, 2, 3, rng.randrange(300)]),) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "v long").repartition(5)
    want = sorted(Counter(v for v, in rows).items(), key=lambda x: (-x[1], x[0]))
    for k in (1, 3, 40, 500):
        assert [tuple(r) for r in heavy.most_frequent(df, "v", k, counters).collect()] == want[:k]
    assert heavy.most_frequent(df.filter("false"), "v", 3).count() == 0


def test_filter_lets_all_members_and_few_others_through(spark):
    listed = spark.range(0, 200_000, 2).select(F.md5(F.col("id").cast("string").cast("binary")).alias("code"))
    rows = spark.range(200_000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("code")).union(spark.createDataFrame([(-1, None)], "id long, code string"))
    found = membership.bloom(listed, ["code"])
    passed = rows.filter(found.may_hold(F.col("code")))
    assert passed.filter("id % 2 = 0").count() == 100_000
    assert passed.filter("id % 2 = 1").count() < 3_000  # of 100,000: what the join has to take out
    assert membership.members(rows, listed, ["code"]).agg(F.count("*"), F.sum("id")).first() == rows.filter("id >= 0 and id % 2 = 0").agg(F.count("*"), F.sum("id")).first()
    assert membership.bloom(listed, ["code"], most_bytes=8).words is None
    assert membership.members(rows, listed.filter("false"), ["code"]).count() == 0


def test_probed_join_keeps_all_rows(spark):
    table = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "k string, l string, v int")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "x"), (4, "b", "y"), (4, "b", "y")], "i int, k string, l string")
    got = sorted((r["i"], r["v"]) for r in membership.probed(rows, table, ["k", "l"]).fillna(-1).collect())
    assert got == [(1, 1), (2, -1), (3, -1), (4, 2), (4, 2)]


def test_merged_sketches_stay_near_the_rank(spark):
    rows = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7.0).alias("x"), (F.col("id") % 40).alias("day"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("k"))
    kept = quantiles.merged(quantiles.sketched(rows, "x", ["day", "k"]), ["k"])
    found = kept.select("k", "n", F.explode(F.array(*[F.struct(F.lit(s).alias("share"), quantiles.quantile(F.col("sketch"), s).alias("estimate")) for s in (0.01, 0.5, 0.99)])).alias("x")).select("k", "n", "x.*")
    assert {r["k"]: r["n"] for r in found.collect()} == {"a": 66_667, "b": 133_333}
    for r in quantiles.rank_errors(rows, found.drop("n"), "x", "k").collect():
        assert r["low"] - 0.01 <= r["share"] <= r["high"] + 0.01
    sizes = [r[0] for r in kept.select(F.octet_length("sketch")).collect()]
    assert max(sizes) < 20_000


# --- the committing sink ------------------------------------------------------------------------------------


def test_samples_are_finished_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"r{i}", "ACGT", "IIII", rng.choice(["S1", "S 2/x", None])) for i in range(500)]
    df = spark.createDataFrame(rows, "read_id string, sequence string, quality string, sample_name string").repartition(4)
    out = str(tmp_path / "out")
    df.write.format("fastq_samples").mode("append").save(out)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["_SUCCESS", "sample=S%202%2Fx", "sample=S1", "sample=undetermined"]
    for name, want in (("S1", "S1"), ("undetermined", None)):
        got = "".join(gzip.decompress(p.read_bytes()).decode() for p in (tmp_path / "out" / f"sample={name}").iterdir())
        assert sorted(got.split("\n")[::4][:-1]) == sorted(f"@{r[0]}" for r in rows if r[3] == want)
    df.filter("sample_name = 'S1'").write.format("fastq_samples").mode("overwrite").option("compress", "false").save(out)
    assert [p.name for p in (tmp_path / "out").glob("sample=*")] == ["sample=S1"]
    assert fastq.read_split(spark, f"{out}/sample=S1").count() == sum(r[3] == "S1" for r in rows)


def test_a_task_that_fails_midway_leaves_nothing(spark, tmp_path):
    rows = [(f"r{i}", "A" * 3_000, "I" * 3_000, f"S{i % 5}") for i in range(3_000)]
    rows[2_500] = ("broken", "ACGT", "III", "S1")  # after whole buffers were written
    df = spark.createDataFrame(rows, "read_id string, sequence string, quality string, sample_name string").coalesce(2)
    with pytest.raises(Exception, match="not a FASTQ record"):
        df.write.format("fastq_samples").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").rglob("*.gz"))


# --- streams with state -------------------------------------------------------------------------------------

SCHEMA = "read_id long, sequence string, sample_name string, classification string, ts timestamp"


@pytest.fixture
def keyed_state(spark):
    for key, value in stateful.STORE.items():
        spark.conf.set(key, value)
    yield
    for key in stateful.STORE:
        spark.conf.unset(key)


def _arrive(spark, folder, rows):
    spark.createDataFrame(rows, "read_id long, sequence string, sample_name string, classification string, m int").select(
        "read_id", "sequence", "sample_name", "classification", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("m"))).alias("ts")
    ).coalesce(1).write.mode("append").parquet(folder)


def _run(spark, found, tmp_path, name):
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / f"{name}-state")).option("path", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(str(tmp_path / name))


def test_first_occurrences_over_restarts(spark, tmp_path, keyed_state):
    source = str(tmp_path / "in")
    _arrive(spark, source, [(1, "AC", "S", "valid", 5), (2, "AC", "S", "valid", 1), (3, "GG", "S", "valid", 2), (4, None, "S", "valid", 2)])

    def found():
        return stateful.first_occurrences(spark.readStream.schema(SCHEMA).parquet(source), "sequence", keep="1 hour")

    assert {r["read_id"] for r in _run(spark, found(), tmp_path, "out").collect()} == {2, 3}
    # the same query goes on from its checkpoint: AC and GG are known
    _arrive(spark, source, [(5, "AC", "S", "valid", 20), (6, "TT", "S", "valid", 21)])
    assert {r["read_id"] for r in _run(spark, found(), tmp_path, "out").collect()} == {2, 3, 6}
    # long after, GG is forgotten
    _arrive(spark, source, [(7, "CC", "S", "valid", 300)])
    _run(spark, found(), tmp_path, "out")
    _arrive(spark, source, [(8, "GG", "S", "valid", 301), (9, "CC", "S", "valid", 302)])
    assert {r["read_id"] for r in _run(spark, found(), tmp_path, "out").collect()} == {2, 3, 6, 7, 8}


def test_finished_samples_are_given_out_once(spark, tmp_path, keyed_state):
    source = str(tmp_path / "in")
    _arrive(spark, source, [(1, "AC", "S1", "valid", 0), (2, "ACG", "S1", "invalid", 10), (3, "T", "S2", "valid", 5), (4, "T", None, "valid", 5)])

    def found():
        return stateful.finished_samples(spark.readStream.schema(SCHEMA).parquet(source), quiet="1 hour")

    _run(spark, found(), tmp_path, "out")
    _arrive(spark, source, [(5, "TT", "S2", "valid", 60), (6, "A", "S3", "valid", 85)])
    _run(spark, found(), tmp_path, "out")
    _arrive(spark, source, [(7, "A", "S3", "valid", 400)])
    out = _run(spark, found(), tmp_path, "out")
    got = sorted((r["sample_name"], r["total"], r["valid"], r["bases"]) for r in out.collect())
    batch = [("S1", 2, 1, 5), ("S2", 2, 2, 3)]
    assert got[:2] == batch and len(got) <= 3
