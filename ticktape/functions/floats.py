"""Float arithmetic and comparison with IEEE-754 results on Spark columns.

Spark raises on ``x / 0`` and sorts NaN above every number; market maths wants ``inf``/``NaN`` from the
division and ``False`` from any comparison with NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 2.220446049250313e-16  # fixed value: gap between 1.0 and the next double
INFINITY = float("inf")


def ieee_div(a: Column, b: Column) -> Column:
    """``a / b`` with ±inf and NaN for a zero divisor (the sign of -0.0 counts)."""
    return F.when(b == 0.0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def gt(a: Column, b: Column) -> Column:
    """``a > b``, False when either side is NaN."""
    return (a > b) & ~F.isnan(a)


def lt(a: Column, b: Column) -> Column:
    """``a < b``, False when either side is NaN."""
    return (a < b) & ~F.isnan(b)


def gt_value(a: Column, value: float) -> Column:
    """``a > value`` for a constant.  ``a <= inf`` is the NaN guard a Parquet scan can evaluate."""
    if math.isnan(value):
        return F.lit(False)
    return (a > F.lit(value)) & (a <= F.lit(INFINITY))


def lt_value(a: Column, value: float) -> Column:
    """``a < value`` for a constant; a NaN ``a`` sorts above and needs no guard."""
    return F.lit(False) if math.isnan(value) else a < F.lit(value)


def close_to(a: Column, b: Column) -> Column:
    """Equality within the absolute tolerance ``EPSILON``; False for NaN and for equal infinities."""
    return F.abs(a - b) < F.lit(EPSILON)


def close_to_value(a: Column, value: float) -> Column:
    """``close_to`` a constant, led by a slightly wider range a Parquet scan can evaluate."""
    if not math.isfinite(value):
        return F.lit(False)
    return a.between(F.lit(value - 1e-15), F.lit(value + 1e-15)) & close_to(a, F.lit(value))
