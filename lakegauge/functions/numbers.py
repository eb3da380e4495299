"""Rounding shared by every ratio and percentage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int) -> Column:
    """Round a non-negative double on its binary value.

    ``F.round`` rounds the shortest decimal text instead, which lifts a ratio
    such as 9 / 60000, stored just below 0.00015, to 0.0002.
    """
    scale = float(10**digits)
    return F.floor(value * F.lit(scale) + F.lit(0.5)) / F.lit(scale)
