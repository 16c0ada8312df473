"""Spark-native analytics over labelled sequencing reads."""
