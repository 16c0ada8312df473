"""Readers and writers of the formats around labelled reads."""

from readloom.sources.fasta import FastaSource
from readloom.sources.fastq import FastqSource
from readloom.sources.fastq_sink import FastqSamples
from readloom.sources.ranges import FastaRanges


def register(spark) -> None:
    """Makes the formats ``fastq``, ``fasta``, ``fasta_ranges`` and ``fastq_samples`` known to a session."""
    for source in (FastqSource, FastaSource, FastaRanges, FastqSamples):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # names to read reach fasta_ranges


__all__ = ["FastaRanges", "FastaSource", "FastqSamples", "FastqSource", "register"]
