"""Exact rational arithmetic on whole numbers, and its publication as rounded doubles.

A rational is a numerator and a positive denominator, both DECIMAL(38,0) once they may
leave the range of BIGINT. Gates compare cross products; only published columns are
doubles, rounded half-even at six places from the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def wide(value: Column) -> Column:
    return value.cast(WIDE)


def published(num: Column, den: Column) -> Column:
    """num / den (num >= 0) at six places, half-even on the exact value; null if either is null or den is 0."""
    n, d = wide(num) * F.lit(1_000_000), F.nullif(wide(den), F.lit(0).cast(WIDE))
    rest = n % d
    whole = ((n - rest) / d).cast("decimal(38,0)")
    up = (rest * 2 > d) | ((rest * 2 == d) & (whole % 2 == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / F.lit(1e6)


def more(num: Column, den: Column, other_num: Column, other_den: Column | int = 1) -> Column:
    """num / den > other_num / other_den for positive denominators."""
    other = F.lit(other_den) if isinstance(other_den, int) else other_den
    return wide(num) * wide(other) > wide(other_num) * wide(den)


def rounded(value: Column, places: int) -> Column:
    """A double at some places (7 at most), half-even by the exact value that its bits stand for.

    The product with the power of ten is taken without error, as the sum of two doubles.
    """
    scale = float(10**places)
    high = value * 134217729.0 - (value * 134217729.0 - value)  # the upper half of the value's bits
    product = value * scale
    error = (high * scale - product) + (value - high) * scale
    below = F.floor(product).cast("double")
    half = product - below
    up = (half > 0.5) | ((half == 0.5) & ((error > 0) | ((error == 0) & (below % 2 != 0))))
    whole = below + F.when(up, 1.0).otherwise(0.0)
    return F.when(whole == 0, value * 0.0).otherwise(whole / scale)  # a zero keeps its sign
