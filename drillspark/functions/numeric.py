"""Numeric Column helpers that keep results identical across engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dround(col: str | Column, digits: int) -> Column:
    """Round a double half away from zero on its binary value.

    ``sign(x) * floor(|x * 10^d| + 0.5) / 10^d``: this is how SQL engines that
    round the IEEE value behave (1.005 -> 1.0), whereas Spark's ``round`` works
    on the shortest decimal text (1.005 -> 1.01). Using one rule everywhere
    keeps tool outputs equal to SQL recomputations. Null stays null.
    """
    m = float(10**digits)
    x = _c(col).cast("double")
    scaled = x * F.lit(m)
    rounded = (F.signum(scaled) * F.floor(F.abs(scaled) + F.lit(0.5)).cast("double")) / F.lit(m)
    # from 2^52 on a double has no fraction left to round (and floor() gives a bigint)
    return F.when(F.abs(scaled) < F.lit(float(2**52)), rounded).otherwise(x)
