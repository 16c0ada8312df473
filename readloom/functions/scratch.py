"""The folder that driver and executors share, and what a run leaves there while it lasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: All that this process writes for its own use is in one folder of this name, which goes when the process ends.
RUN = uuid.uuid4().hex
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the setting is absent under a local master (tests, local runs) a temporary folder of this machine stands in.
    """
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        there = tempfile.mkdtemp(prefix="readloom-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in this run's part of the shared folder."""
    own = f"{shared_dir(spark)}/readloom/{RUN}"
    if not _used:
        atexit.register(_clear)
    _used.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written into this run's folder and read from there: what uses it more than once computes it once."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(path: str) -> None:
    """Removes a path through the store that it is on."""
    jvm = SparkContext._gateway.jvm
    there = jvm.org.apache.hadoop.fs.Path(path)
    running = SparkContext._active_spark_context
    conf = running._jsc.hadoopConfiguration() if running is not None else jvm.org.apache.hadoop.conf.Configuration()
    there.getFileSystem(conf).delete(there, True)


def _clear() -> None:
    for path in _used:
        try:
            remove(path)
        except Exception as problem:  # the process ends; what is left is named
            print(f"{path} is left: {str(problem)[:200]}")
