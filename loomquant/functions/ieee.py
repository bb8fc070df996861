"""Division and logarithm as the floating-point standard has them: a number by 0 is infinite, 0 by 0 is NaN, the logarithm
of 0 is minus infinity; null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY, NAN = float("inf"), float("nan")


def divide(a: Column, b: Column) -> Column:
    by_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INFINITY)).when(a < 0, F.lit(-INFINITY))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def log(x: Column) -> Column:
    return F.when(x == 0, F.lit(-INFINITY)).when(x < 0, F.lit(NAN)).otherwise(F.ln(x))


def log_return(now: Column, before: Column) -> Column:
    """Logarithm of a price over the one before: minus infinity where it falls to 0, infinity where it comes back."""
    return log(divide(now.cast("double"), before.cast("double")))
