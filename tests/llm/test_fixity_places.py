"""Records without length share their place with the next one; each damage has to be reported."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from readloom.llm import merkle_fixity, queries

SCHEMA = "archive string, offset long, length long, payload string, page_id long"


def test_each_record_of_a_place_is_reported(spark):
    a = [("f", 0, 0, None, 1), ("f", 0, 0, "", 2), ("f", 0, 0, "", 3), ("f", 0, 4, "page", 4)]  # all but one lost or altered
    a += [("f", 4, 0, "", 5), ("f", 4, 0, "", 6), ("f", 4, 0, "", 7), ("f", 4, 3, "abc", 8)]  # two copies of three lost, one page cut
    b = [("f", 0, 0, None, 0), ("f", 0, 4, "pagE", 0), ("f", 4, 0, "", 0), ("f", 4, 2, "ab", 0)]
    one, two = spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA)
    found = merkle_fixity.audit(one, two, keys=("page_id",)).collect()
    got = sorted((r["offset"], r["kind"], r["page_id"] or 0, r["length"], -1 if r["replica_length"] is None else r["replica_length"]) for r in found)
    want = [(0, "altered", 4, 4, 4), (0, "missing", 2, 0, -1), (0, "missing", 3, 0, -1)]
    want += [(4, "missing", 0, 0, -1), (4, "missing", 0, 0, -1), (4, "resized", 8, 3, 2)]
    assert got == want


def test_three_lost_at_one_offset(spark):
    a = [("f", 0, 0, None, 1), ("f", 0, 0, "", 2), ("f", 0, 4, "page", 3), ("f", 4, 4, "next", 4)]
    found = merkle_fixity.audit(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(a[3:], SCHEMA), keys=("page_id",)).collect()
    assert sorted((r["page_id"], r["kind"]) for r in found) == [(1, "missing"), (2, "missing"), (3, "missing")]


def test_keys_may_have_any_name_and_offsets_be_missing(spark):
    a = [("f", None, 3, f"p{i}", i, f"d{i}") for i in range(200)] + [("f", 10, 3, "abc", 999, "x")]
    schema = "arc string, at long, size long, body string, offset long, digest string"
    one = spark.createDataFrame(a, schema)
    two = spark.createDataFrame([r for r in a if r[4] not in (7, 9)], schema).withColumn("body", F.regexp_replace("body", "^p11$", "p-"))
    found = merkle_fixity.audit(one, two, "arc", "at", "size", "body", keys=("offset", "digest"))
    rows = found.toDF("archive", "place", "key0", "key1", *found.columns[4:]).collect()
    lost = sorted((r["key0"], r["kind"]) for r in rows if r["key0"] is not None)
    assert [k for k, _ in lost] == [7, 9, 11] and {r["place"] for r in rows} == {-1} and len(rows) == 3


def test_replicas_keep_payloads_out_of_the_shuffle(spark, sf):
    plan = queries.replicas(spark.read.parquet(f"{sf}/pages.parquet"))[0]._jdf.queryExecution().toString()
    assert "html" not in plan


@pytest.mark.parametrize("codec", [None, "gzip"])
def test_warc_round_trip(spark, tmp_path, codec):
    texts = ["", None, "plain", "two\r\n\r\nline ends\r\n\r\n", "of WARC/1.0\r\nnot a record", "été 漢字", "x" * 100_000, "\n\n", "\r\n\r\n"]
    rows = [(f"a{i % 2}", i, None if i == 3 else f"http://x/{i}", t) for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "archive string, offset long, url string, payload string")
    merkle_fixity.write_warc(df, str(tmp_path / "w"))
    if codec:
        import gzip

        for p in list((tmp_path / "w").rglob("part-*")):
            (p.parent / (p.name + ".gz")).write_bytes(gzip.compress(p.read_bytes()))
            p.unlink()
    got = merkle_fixity.warc_records(spark, str(tmp_path / "w" / "*"), keep_block=True).orderBy("archive", "offset").collect()
    want = sorted(rows, key=lambda r: (r[0], r[1]))
    assert [(r["url"], r["block"]) for r in got] == [(u, t or "") for _, _, u, t in want] and all(r["whole"] for r in got)
    if not codec:
        for r in got:  # offsets and lengths are those of the file
            data = open(r["archive"].removeprefix("file:"), "rb").read()[r["offset"] : r["offset"] + r["length"]]
            assert data.startswith(b"WARC/1.0\r\n") and data.endswith((r["block"] + "\r\n\r\n").encode())
    # one replica's block is altered: the audit names the record
    records = spark.createDataFrame(got).withColumn("archive", F.regexp_extract("archive", "archive=(a.)", 1)).select("archive", "offset", "length", "id", "digest")
    broken = records.withColumn("digest", F.when(F.col("id") == got[5]["id"], "bad").otherwise(F.col("digest")))
    (odd,) = [r for r in merkle_fixity.audit(records, broken, keys=("id",), digest="digest").collect() if r["digest"] == got[5]["digest"]][:1]
    assert odd["kind"] == "altered"


def test_cut_warc_records_are_marked(spark, tmp_path):
    merkle_fixity.write_warc(spark.createDataFrame([("a", 1, None, "WARC/1.0\r\ninside"), ("a", 2, None, "whole")], "archive string, offset long, url string, payload string"), str(tmp_path / "w"))
    got = merkle_fixity.warc_records(spark, str(tmp_path / "w" / "*")).orderBy("offset").collect()
    assert [r["whole"] for r in got] == [False, False, True] and got[2]["offset"] == got[0]["length"] + got[1]["length"]
    (file,) = (tmp_path / "w").rglob("part-*")
    short = tmp_path / "short.warc"
    short.write_bytes(file.read_bytes()[:-7])
    assert [r["whole"] for r in merkle_fixity.warc_records(spark, str(short)).orderBy("offset").collect()] == [False, False, False]
    (tmp_path / "none.warc").write_bytes(b"")
    assert merkle_fixity.warc_records(spark, str(tmp_path / "none.warc")).count() == 0


def _warc(version: str, n: int, body: str = "body", end: str = "\r\n") -> str:
    return end.join([f"WARC/{version}", "WARC-Type: resource", f"WARC-Record-ID: <urn:{version}:{n}>", f"Content-Length: {len(body)}", "", body, "", ""])


def test_records_of_any_version(spark, tmp_path):
    texts = [_warc(v, i, b) for i, (v, b) in enumerate([("1.1", "one"), ("1.0", ""), ("1.1", "a\r\n\r\nb"), ("0.18", "z")])]
    (tmp_path / "mixed.warc").write_bytes("".join(texts).encode())
    (tmp_path / "empty.warc").write_bytes(b"")
    found = sorted(merkle_fixity.warc_records(spark, str(tmp_path), keep_block=True).collect(), key=lambda r: r["offset"])
    assert [r["id"] for r in found] == ["<urn:1.1:0>", "<urn:1.0:1>", "<urn:1.1:2>", "<urn:0.18:3>"]
    assert [r["length"] for r in found] == [len(t) for t in texts] and all(r["whole"] for r in found)
    assert [r["offset"] for r in found] == [sum(map(len, texts[:i])) for i in range(4)]
    assert [r["block"] for r in found] == ["one", "", "a\r\n\r\nb", "z"]


def test_files_that_are_no_warc_are_refused(spark, tmp_path):
    for i, text in enumerate(("just text", _warc("1.0", 1, end="\n"), "junk\r\n" + _warc("1.1", 1))):
        (tmp_path / f"{i}.warc").write_bytes(text.encode())
        with pytest.raises(Exception, match="not a WARC file"):
            merkle_fixity.warc_records(spark, str(tmp_path / f"{i}.warc")).collect()
