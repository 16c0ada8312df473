from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from readloom.functions import seq
from readloom.operators import demux, motif, runs, simulate
from readloom.queries import MATRIX
from readloom.schema import LABELS


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("s, want", [("ACGTN", "NACGT"), ("acgu", "NCGT"), ("", ""), ("RY", "NN")])
def test_reverse_complement(spark, s, want):
    assert one(spark, seq.reverse_complement(F.lit(s))) == want
    twice = seq.reverse_complement(seq.reverse_complement(F.lit("ACGTNNTG")))
    assert one(spark, twice) == "ACGTNNTG"


@pytest.mark.parametrize("s, want", [("CC" + "A" * 9, "CC" + "A" * 9), ("CC" + "A" * 10, "CC"), ("CCAA" + "N" + "A" * 10, "CCA"), ("", "")])
def test_polya(spark, s, want):
    assert one(spark, seq.trim_polya(F.lit(s))) == want


def test_arrays(spark):
    assert one(spark, seq.encode(F.lit("acgtnux"), "training")) == [0, 1, 2, 3, 4, 0, 4]
    assert one(spark, seq.encode(F.lit(""), "demux")) == []
    assert one(spark, seq.one_hot(F.array(F.lit(1), F.lit(0)), 3)) == [[0, 1, 0], [1, 0, 0]]
    assert one(spark, seq.encode_labels(F.array(F.lit("ACC"), F.lit("?")))) == [LABELS.index("ACC"), 0]
    assert one(spark, seq.softmax(F.array(F.lit(800.0), F.lit(800.0)))) == [0.5, 0.5]
    assert one(spark, seq.confidence(F.array(F.array(F.lit(0.2), F.lit(0.8)), F.array(F.lit(0.5), F.lit(0.5))), F.lit(1))) == 0.8
    assert set(one(spark, seq.iupac_resolve(F.lit("NNRY"), 3, F.lit(1)))) <= set("ACGT")


def test_lcs(spark):
    rng = random.Random(1)
    pairs = [("AGCAT", "GAC"), ("ABCBDAB", "BDCABA"), ("", "AB"), ("AB", "")]
    pairs += [("".join(rng.choices("ABC", k=rng.randint(0, 7))), "".join(rng.choices("ABC", k=rng.randint(0, 7)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, ["a", "b"])
    got = df.select("a", "b", seq.lcs_length(seq.letters(F.col("a")), seq.letters(F.col("b"))).alias("n")).collect()
    assert [r["n"] for r in got] == [lcs(a, b) for a, b in pairs]


def test_regions_with_ghosts(spark):
    labels = ["UMI", "UMI", "ERROR_SUB", "UMI", "ACC", "ACC", "ERROR_BOUNDARY"]
    df = spark.createDataFrame([(labels,), ([],), (["ERROR_SUB", "ACC"],)], "labels array<string>")
    got = [[tuple(x) for x in r[0]] for r in df.select(runs.regions(F.col("labels"))).collect()]
    assert got == [[("UMI", 0, 4), ("ACC", 4, 6)], [], [("ACC", 1, 2)]]


def test_boundaries_keep_the_last_run(spark):
    df = spark.createDataFrame([("AACCGG", ["UMI", "UMI", "PAD", "UMI", "ACC", "ACC"])], "sequence string, labels array<string>")
    segs = runs.segments(F.col("labels"), F.length("sequence"))
    row = df.select(segs.alias("s"), runs.slice_of(F.col("sequence"), runs.last_boundaries(segs), "UMI").alias("umi")).first()
    assert [tuple(x) for x in row["s"]] == [("UMI", 0, 2), ("UMI", 3, 4), ("ACC", 4, 6)] and row["umi"] == "C"


def test_motif_golden_values(spark):
    want = {"ACCGGG": 1.0, "ACCGGC": 0.945863, "TTTTTT": 0.186475, "AAAAAA": 0.338037, "GCCGGG": 0.814726, "GGGGGG": 0.503333, "NNNNNN": 0.0}
    df = spark.createDataFrame([(k,) for k in want], ["m"])
    got = {r["m"]: r["s"] for r in df.select("m", motif.score(F.col("m"), MATRIX).alias("s")).collect()}
    assert got == pytest.approx(want, abs=1e-6)
    assert one(spark, motif.score(F.lit("ACC"), MATRIX)) is None
    assert tuple(one(spark, motif.best_match(F.lit("AC"), MATRIX))) == (0.0, -1, "")
    assert tuple(one(spark, motif.best_match(F.lit("TTACCGGGACCGGG"), MATRIX))) == (pytest.approx(1.0), 2, "ACCGGG")


def test_tempered_matrix_is_a_distribution():
    for t in (0.5, 1.0, 3.0):
        for p in motif.tempered(MATRIX, t, 0.4):
            assert sum(p.values()) == pytest.approx(1)
    assert len(motif.from_pattern("ACCSSV")) == 6


def test_validation(spark):
    rows = [
        (["p7", "i7", "RP2", "UMI", "ACC", "cDNA", "polyA", "CBC", "RP1", "i5", "p5"], "valid", "forward"),
        (["p5", "i5", "CBC", "cDNA", "ACC", "UMI", "i7", "p7"], "valid", "reverse"),
        (["p7", "i7", "UMI", "ACC", "cDNA", "CBC", "i5", "p5", "odd"], "ambiguous", "forward"),
        (["p7", "i7", "ACC", "cDNA", "CBC", "i5", "p5"], "invalid", "forward"),
        ([], "invalid", "unknown"),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "s array<string>")
    got = [(r[0]["classification"], r[0]["orientation"]) for r in df.select(demux.validate(F.col("s"))).collect()]
    assert got == [r[1:] for r in rows]


def test_large_sheets_find_the_same_matches(spark):
    rng = random.Random(3)

    def code(n):
        return "".join(rng.choices("ACGT", k=n))

    sheet = [(i, f"S{i}", code(8), code(8), code(8)) for i in range(60)]
    reads = []
    for _ in range(200):
        s = list(rng.choice(sheet)[2:])
        for _ in range(rng.randint(0, 3)):
            k, at = rng.randrange(3), rng.randrange(8)
            s[k] = s[k][:at] + rng.choice(["", rng.choice("ACGT"), rng.choice("ACGT") * 2]) + s[k][at + 1 :]
        reads.append(tuple(s))
    a = spark.createDataFrame(sheet, "sheet_ordinal long, sample_name string, cbc string, i5 string, i7 string")
    b = spark.createDataFrame(reads, "cbc string, i5 string, i7 string").distinct()
    near = {tuple(r) for r in demux.nearest(b, a).collect()}
    assert near and near == {tuple(r) for r in demux.nearest(b, a, everywhere=0).collect()}


def test_corruption_keeps_labels_and_bases_together(spark):
    reads = simulate.generate(spark, 400, [simulate.Source("UMI", length=30), simulate.Source("ACC", length=30), simulate.Source("CBC", length=40)], 5)
    out = simulate.corrupt(reads, 9, 1.0)
    assert out.filter(F.size("labels") != F.length("sequence")).count() == 0
    kinds = {r[0] for r in out.select("error_type").distinct().collect()}
    assert {"segment_loss", "segment_duplication", "truncation", "chimeric", "scrambled"} <= kinds
    errors = simulate.sequencing_errors(reads, 3, 0.2)
    assert errors.filter(F.size("labels") != F.length("sequence")).count() == 0
