"""Sources that read large files in parts give the same rows as one reader of the whole file, wherever the borders fall."""

from __future__ import annotations

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from readloom.sources import fasta, fastq, json_arrays, tables


@pytest.fixture
def parts(spark):
    """Sets the size of parts."""

    def small(size: int):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")

    yield small
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def fasta_rows(data: bytes):
    """(header, sequence, offset of the first base, bases and bytes of the first line) by one pass over all lines."""
    out, at = [], 0
    for line in data.split(b"\n"):
        raw, text = len(line) + 1, line.rstrip(b"\r")
        if text.startswith(b">"):
            out.append([text[1:].decode(), "", at + raw, None, None])
        elif out and text.strip() and not text.startswith(b";"):
            if not out[-1][1]:
                out[-1][3:] = [len(text), min(raw, len(data) - at)]
            out[-1][1] += text.decode()
        at += raw
    return [tuple(r) for r in out]


def fasta_text(rng, end: str, last: bool) -> bytes:
    lines = ["; a note"] if rng.random() < 0.5 else []
    for i in range(rng.randint(0, 60)):
        lines.append(f">r{i}{rng.choice(['', ' of x', chr(9) + 'of x', ' été'])}")
        width = rng.choice([1, 7, 60])
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 300, 4_000])))
        lines += [seq[j : j + width] for j in range(0, len(seq), width)] + rng.choice([[], [], [""], ["; note"]])
    return (end.join(lines) + (end if last else "")).encode()


@pytest.mark.parametrize("size", [2_000, 10**7])
def test_fasta_in_parts(spark, tmp_path, parts, size):
    rng = random.Random(size)
    want = []
    for k in range(6):
        data = fasta_text(rng, ["\n", "\r\n"][k % 2], k % 3 > 0)
        name = f"f{k}.fa" + (".gz" if k == 5 else "")
        (tmp_path / name).write_bytes(gzip.compress(data) if k == 5 else data)
        rows = fasta_rows(data)
        if k == 5 and rows and rows[-1][1] and rows[-1][4] is not None and not data.endswith(b"\n"):
            rows = rows[:-1]
        want += [(name, *r) for r in rows]
    (tmp_path / "empty.fa").write_bytes(b"")
    parts(size)
    got = fasta.read_split(spark, str(tmp_path)).collect()
    found = [(r["file"].rsplit("/", 1)[1], *(r[c] for c in ("header", "sequence", "offset", "line_bases", "line_width"))) for r in got]
    assert set(want) <= set(found) and len(found) - len(want) <= 1
    assert all(r["name"] == r["header"].split()[0] for r in got)


def test_both_fasta_readers_agree(spark, tmp_path, parts):
    from readloom import sources

    sources.register(spark)
    for k, end in enumerate(("\n", "\r\n")):
        (tmp_path / f"x{k}.fa").write_bytes(end.join([">a\tfirst", "ACGT", "AC", "", ">b", ">c two", "GG", ""]).encode())
    parts(9)
    columns = ("name", "header", "sequence", "offset")
    key = lambda df: sorted(tuple(r[c] for c in columns) for r in df.collect())
    assert key(fasta.read_split(spark, str(tmp_path))) == key(spark.read.format("fasta").load(str(tmp_path)))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [400, 10**7])
def test_fastq_in_parts_of_any_size(spark, tmp_path, parts, size, end):
    rng = random.Random(size)
    want = []
    for f in range(3):
        rows = [(f"r{f}.{i}", "".join(rng.choices("ACGT", k=n)), "".join(rng.choices("@+I#", k=n))) for i, n in enumerate(rng.choices([0, 1, 5, 60], k=300))]
        text = "".join(end.join([f"@{i} c", s, "+", q, ""]) for i, s, q in rows)
        (tmp_path / f"f{f}.fq").write_bytes(text.encode())
        want += rows
    parts(size)
    got = fastq.read_split(spark, str(tmp_path)).collect()
    assert sorted((r["read_id"], r["sequence"], r["quality"]) for r in got) == sorted(want)
    few = fastq.read_split(spark, str(tmp_path), most_per_file=130).collect()
    assert sorted(r["read_id"] for r in few) == sorted(f"r{f}.{i}" for f in range(3) for i in range(130))


def array_texts(rng, rows):
    """The same list in several layouts."""
    other = {"reads": "not these", "n": [1, {"reads": [{"sequence": "no"}]}], "note": 'a "}] quote\\', "deep": {"x": {"y": [{"z": {}}]}}}
    return {
        "bare": json.dumps(rows),
        "tight": json.dumps(rows, separators=(",", ":")),
        "indented": "\n\t" + json.dumps(rows, indent=2) + "\n",
        "wrapped": json.dumps({"reads": rows, "metadata": other}),
        "after": json.dumps({"metadata": other, "reads": rows}, indent=1),
        "between": "﻿" + json.dumps({"metadata": other, "reads": rows, "z": {"reads": [{"sequence": "no"}]}}),
    }


@pytest.mark.parametrize("size", [150, 10**7])
def test_arrays_of_any_layout(spark, tmp_path, parts, size):
    rng = random.Random(size)
    junk = ['"', "\\", "}", "{", "[", "]", ",", "é", "\n", "reads", '"reads": [', "\\\\", ":"]
    rows = [
        {"sequence": "".join(rng.choices([*"ACGT", *junk], k=rng.choice([0, 3, 50]))), "labels": rng.choices(junk, k=3), "label_regions": {"A": [[0, 4], [6, 9]]}, "metadata": {"i": i, "x": {"y": [{}]}}}
        for i in range(60)
    ]
    for name, text in array_texts(rng, rows).items():
        path = tmp_path / name
        path.mkdir()
        (path / "a.json").write_text(text)
        (path / "empty.json").write_text("" if size > 1_000 else " ")
        parts(size)
        found = [json.loads(r["value"]) for r in json_arrays.elements(spark, str(path), "reads").collect()]
        key = lambda r: json.dumps(r, sort_keys=True)
        assert sorted(found, key=key) == sorted(rows, key=key), name
        typed = tables.read_invalid(spark, str(path / "a.json")).collect()
        assert sorted(r["sequence"] for r in typed) == sorted(r["sequence"] for r in rows)
        assert all(r["label_regions"] == {"A": [[0, 4], [6, 9]]} for r in typed)


def test_arrays_that_are_refused(spark, tmp_path):
    for i, (text, message) in enumerate([('[{"a": 1}, 2]', "no object"), ('[{"a": 1}, "x"]', "no object"), ('[{"a": 1}', "ends within"), ('{"reads": [{"a": "x}]', "ends within"), ("7", "not an array")]):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(Exception, match=message):
            json_arrays.elements(spark, str(tmp_path / f"{i}.json"), "reads").collect()
    (tmp_path / "o.json").write_text('{"reads": []}')
    assert json_arrays.elements(spark, str(tmp_path / "o.json"), "reads").count() == 0
    with pytest.raises(ValueError, match="not an array"):
        json_arrays.elements(spark, str(tmp_path / "o.json"))
    (tmp_path / "w.json").write_text('{"reads": [{"a": 1}, 3], "x": 5}')
    with pytest.raises(Exception, match="no object"):
        json_arrays.elements(spark, str(tmp_path / "w.json"), "reads").collect()


def test_lines_are_told_from_arrays(spark, tmp_path):
    rows = [{"sequence": "ACG", "labels": ["A"], "metadata": {"n": "1"}}, {"metadata": {"n": "2"}, "sequence": "TT", "labels": []}]
    for name, chosen in (("a", rows), ("b", rows[::-1])):
        (tmp_path / name).write_text("\n".join(map(json.dumps, chosen)))
        got = tables.read_labelled_json(spark, str(tmp_path / name), "sequence string, labels array<string>").collect()
        assert sorted(r["sequence"] for r in got) == ["ACG", "TT"]
    (tmp_path / "c").write_text('{"sequence": "A"}\n{"sequence": ')
    with pytest.raises(Exception):
        tables.read_labelled_json(spark, str(tmp_path / "c"), "sequence string").collect()


def test_lists_of_text_are_parsed_as_they_are_first(spark, tmp_path):
    (tmp_path / "o.tsv").write_text("model\tsegments\na\t[\"it's\", \"b\"]\nb\t['x', 'y']\nc\t\n")
    got = {r["model"]: r["segments"] for r in tables.read_orders(spark, str(tmp_path / "o.tsv"), ["segments"]).collect()}
    assert got == {"a": ["it's", "b"], "b": ["x", "y"], "c": None}
    (tmp_path / "p.tsv").write_text("model\tsegments\na\tx, y\n")
    with pytest.raises(Exception, match="no list"):
        tables.read_orders(spark, str(tmp_path / "p.tsv"), ["segments"]).collect()
