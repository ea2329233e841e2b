"""Statistics as Column arithmetic: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
Z95 = 1.96
RELATIVE_TOLERANCE = 0.02
RATE_TOLERANCE = 0.005


def ratio(numerator: Column, denominator: Column) -> Column:
    """Floating division, NULL on a zero denominator (ANSI mode would raise)."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def round2(x: Column) -> Column:
    """Half-up to two decimals, the rounding the scores are defined with."""
    return F.floor(x * 100 + 0.5) / 100


def wilson(p: Column, n: Column, z: float = Z95) -> Column:
    """95% Wilson score interval as ``struct<lo, hi>``; an empty sample says nothing: (0, 1)."""
    n = n.cast("double")
    p = F.least(F.greatest(p.cast("double"), F.lit(0.0)), F.lit(1.0))
    z2 = z * z
    denom = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    centre = F.try_divide(p + F.try_divide(F.lit(z2), n * 2), denom)
    spread = F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z2), n * n * 4))
    half = F.try_divide(F.lit(z), denom) * spread
    return F.struct(
        F.when(n <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)).alias("lo"),
        F.when(n <= 0, 1.0).otherwise(F.least(F.lit(1.0), centre + half)).alias("hi"),
    )


def half_width_pp(lo: Column, hi: Column) -> Column:
    return (hi - lo) / 2 * 100


def _scale(a: Column, b: Column) -> Column:
    return F.greatest(F.abs(a), F.abs(b), F.lit(1e-9))


def agrees(a: Column, b: Column) -> Column:
    """Within 2% of the larger, or within 0.005 when both read as rates."""
    a, b = a.cast("double"), b.cast("double")
    absolute = F.when((F.abs(a) <= 1) & (F.abs(b) <= 1), RATE_TOLERANCE).otherwise(0.0)
    return F.abs(a - b) <= F.greatest(absolute, _scale(a, b) * RELATIVE_TOLERANCE)


def relative_delta(a: Column, b: Column) -> Column:
    a, b = a.cast("double"), b.cast("double")
    return F.abs(a - b) / _scale(a, b)
