"""Deterministic random numbers: functions of a seed, a row's id and a draw number, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *parts: Column | int | str) -> Column:
    """A double in [0, 1), the same for the same seed and parts on any cluster."""
    keys = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 53)) / float(1 << 53)


def pick(seed: int, n: Column | int, *parts: Column | int | str) -> Column:
    """A whole number from 0 to n - 1."""
    n = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(uniform(seed, *parts) * n), n - 1).cast("int")


def normal(seed: int, *parts: Column | int | str) -> Column:
    """A standard normal draw (Box-Muller on two uniform draws)."""
    u, v = uniform(seed, *parts, 1), uniform(seed, *parts, 2)
    return F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
