"""Demultiplexing of reads as files arrive: the batch plan over a file stream, with running counters.

Assignment is stateless apart from the sheet, so each micro-batch is the batch plan itself; counters are an
aggregation that Structured Streaming keeps and recovers from its checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from readloom.operators import demux


def arriving(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files that land in a folder, a bounded number of them in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def counts(reads: DataFrame, sheet: DataFrame) -> DataFrame:
    """Running (sample_name, total, valid) of exactly matched reads: one stateful grouping with a row a sample."""
    named = demux.exact(reads, sheet).withColumn("sample_name", F.coalesce("sample_name", F.lit("undetermined")))
    return named.groupBy("sample_name").agg(F.count("*").alias("total"), F.count_if(F.col("classification") == "valid").alias("valid"))


def assign_each_batch(reads: DataFrame, sheet: DataFrame, out: str, checkpoint: str, most: int = 2) -> StreamingQuery:
    """Writes every micro-batch's assignments, exact and corrected, partitioned by sample.

    A batch that is run again overwrites its own folder, so each read is written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        demux.assign(batch, sheet, most).write.mode("overwrite").partitionBy("sample_name").parquet(f"{out}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rates(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Reads a window of event time and sample; rows later than the watermark are left out and state is dropped."""
    timed = events.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "sample_name").agg(F.count("*").alias("reads"))
