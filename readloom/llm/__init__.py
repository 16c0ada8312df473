"""Corpus operators for large-scale training-data pipelines, each expressed as Spark jobs."""
