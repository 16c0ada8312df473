from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readloom import sources
from readloom.sources import fasta, fastq, sinks, tables

FASTQ = "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+\n+I\n@r3\nTTT\n+\nIII\n"


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    sources.register(spark)


def test_fastq(spark, tmp_path):
    (tmp_path / "a.fastq").write_text(FASTQ)
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@z\nA\n+\nI\n")
    rows = spark.read.format("fastq").load(str(tmp_path)).collect()
    assert sorted(r["read_id"] for r in rows) == ["r1", "r2", "r3", "z"]
    few = spark.read.format("fastq").option("max_reads", "2").load(str(tmp_path / "a.fastq"))
    assert few.count() == 2
    want = [("r1", "ACGT", "@III"), ("r2", "GG", "+I"), ("r3", "TTT", "III")]
    split = fastq.read_split(spark, str(tmp_path / "a.fastq")).collect()
    assert sorted((r["read_id"], r["sequence"], r["quality"]) for r in split) == want and all(r["file"].endswith("a.fastq") for r in split)
    both = fastq.read_split(spark, str(tmp_path)).collect()
    assert sorted((r["read_id"], r["sequence"], r["quality"]) for r in both) == [*want, ("z", "A", "I")]


def test_fastq_in_many_parts(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(4_000):
        n = rng.choice([0, 1, 5, 60])
        rows.append((f"r{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I#", k=n))))
    (tmp_path / "big.fq").write_text("".join(f"@{i} c\n{s}\n+{i}\n{q}\n" for i, s, q in rows) + "\n")
    (tmp_path / "win.fq").write_bytes(b"@w\r\nAC\r\n+\r\n++\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        got = fastq.read_split(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["read_id"], r["sequence"], r["quality"]) for r in got) == sorted([*rows, ("w", "AC", "++")])


def test_broken_fastq_raises(spark, tmp_path):
    (tmp_path / "x.fastq").write_text("@r1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        spark.read.format("fastq").load(str(tmp_path)).collect()
    for text in ("@r1\nACGT\n+\nII\n", "@r1\nA\n+\n", "r1\nA\n+\nI\n"):
        (tmp_path / "x.fastq").write_text(text)
        with pytest.raises(Exception, match="not a FASTQ record"):
            fastq.read_split(spark, str(tmp_path)).collect()


def test_fasta_and_its_index(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">t1 d\nACGT\nAC\n>t2\n\n>t3\nGGGGG\n")
    records = spark.read.format("fasta").load(str(tmp_path / "x.fa"))
    assert {(r["name"], r["sequence"]) for r in records.collect()} == {("t1", "ACGTAC"), ("t2", ""), ("t3", "GGGGG")}
    index = {tuple(r) for r in fasta.index(records).collect()}
    assert index == {("t1", 6, 6, 4, 5), ("t3", 5, 23, 5, 6)}
    (tmp_path / "x.fai").write_text("t1\t6\t6\t4\t5\nbroken\n\nt3\t9\t24\t5\t6\n")
    entries = fasta.read_index(spark, str(tmp_path / "x.fai"))
    assert entries.filter("corrupt is not null").count() == 1
    assert [r["name"] for r in fasta.verify_index(entries.filter("corrupt is null"), records).collect()] == ["t3"]
    got = {(r["name"], r["sequence"]) for r in fasta.read_split(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {("t1", "ACGTAC"), ("t2", ""), ("t3", "GGGGG")}


def test_small_tables(spark, tmp_path):
    (tmp_path / "w.txt").write_text("C1\tacgt\r\nC2\tGGXX\r\n# note\r\nTTTT")
    assert {r["seq"] for r in tables.read_whitelist(spark, str(tmp_path / "w.txt")).collect()} == {"ACGT", "TTTT"}
    (tmp_path / "s.csv").write_text("sample_name,cbc,i5,i7\nA, acgt ,GG,TT\n")
    assert tuple(tables.read_samples(spark, str(tmp_path / "s.csv")).first())[1:] == ("A", "ACGT", "GG", "TT")
    (tmp_path / "bad.csv").write_text("sample_name,cbc\nA,C\n")
    with pytest.raises(ValueError, match="i5, i7"):
        tables.read_samples(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "p.tsv").write_text("#c\nmodel_name\tsequence\tfrequency\nm\tAC\t3\nm\tGT\t1\nn\tAA\tN/A\n")
    got = {(r["model_name"], r["sequence"]): r["frequency"] for r in tables.read_priors(spark, str(tmp_path / "p.tsv")).collect()}
    assert got == {("m", "AC"): 0.75, ("m", "GT"): 0.25}
    (tmp_path / "n.txt").write_text("12\nx\n7\n")
    assert sorted(r["n"] for r in tables.read_lengths(spark, str(tmp_path / "n.txt")).collect()) == [7, 12]


def test_reads_round_trip(spark, tmp_path):
    reads = spark.createDataFrame([(1, "ACG", ["UMI", "UMI", "ACC"])], "read_id long, sequence string, labels array<string>")
    sinks.write_reads(reads, str(tmp_path / "t"), "text", compress=False)
    back = tables.read_labelled(spark, str(tmp_path / "t")).first()
    assert (back["sequence"], back["labels"]) == ("ACG", ["UMI", "UMI", "ACC"])
    named = reads.withColumn("quality", F.lit("III")).withColumn("sample_name", F.lit("A"))
    fastq.write_by_sample(named, str(tmp_path / "f"), compress=False)
    assert spark.read.text(str(tmp_path / "f")).filter("sample = 'A'").count() == 4


def test_fasta_batches_lose_no_record(spark, tmp_path, monkeypatch):
    from readloom.sources import fasta
    from readloom.sources.files import FilePartition

    path = tmp_path / "many.fa"
    path.write_text("".join(f">r{i}\n{'ACGT' * (i % 5)}\n" for i in range(23)))
    monkeypatch.setattr(fasta, "BATCH_ROWS", 4)
    monkeypatch.setattr(fasta, "BATCH_BASES", 30)
    batches = list(fasta.FastaReader({"path": str(path)}).read(FilePartition(str(path))))
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(batches) > 5 and [r["name"] for r in rows] == [f"r{i}" for i in range(23)]
    assert [r["sequence"] for r in rows] == ["ACGT" * (i % 5) for i in range(23)]
