from __future__ import annotations

import subprocess
import sys
import textwrap
from pathlib import Path

from readloom.functions import scratch


def test_paths_are_new_and_can_be_removed(spark):
    a, b = scratch.place(spark, "x"), scratch.place(spark, "x")
    assert a != b and f"/readloom/{scratch.RUN}/x-" in a
    spark.range(3).write.parquet(a)
    scratch.remove(a)
    assert not Path(a.removeprefix("file:")).exists()


def test_a_run_leaves_nothing_behind(tmp_path):
    code = f"""
        from pyspark.sql import SparkSession
        from readloom import queries
        spark = SparkSession.builder.master("local[2]").config("spark.checkpoint.dir", "{tmp_path}").config("spark.ui.enabled", "false").getOrCreate()
        assert queries.queries()["fastq_roundtrip"](spark, "/root/testdata/sf0.001").count() == 200
        from pathlib import Path
        assert list(Path("{tmp_path}").rglob("part-*"))
        spark.stop()
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], check=True, cwd=Path(__file__).resolve().parent.parent, timeout=300)
    assert not list(tmp_path.rglob("part-*"))
