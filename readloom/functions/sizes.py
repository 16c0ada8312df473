"""Checks of the size of tables that are sent to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def at_most(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df``, which has ``most`` rows at most; a larger one is refused, not cut."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} {what}")
    return df
