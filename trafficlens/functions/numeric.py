"""Number helpers: exact squares, safe ratios, weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDE = "decimal(38,0)"


def wide(value: Column) -> Column:
    """A bigint as decimal(19,0), whose products and sums do not wrap."""
    return value.cast("decimal(19,0)")


def sum_of_squares(value: Column) -> Column:
    """Exact sum of x^2 of a bigint, as decimal(38,0).

    Squares that fit a bigint, nearly all, are added up as two bigint halves, several times faster
    than decimals; larger ones as decimals.
    """
    square = F.try_multiply(value, value)
    low = F.sum(square.bitwiseAND(F.lit(2**32 - 1))).cast(WIDE)
    high = F.sum(F.shiftright(square, 32)).cast(WIDE)
    large = F.sum(F.when(square.isNull(), wide(value) * wide(value)))
    zero = F.lit(0).cast(WIDE)
    small = F.coalesce(high, zero) * F.lit(2**32).cast("decimal(10,0)") + F.coalesce(low, zero)
    return (small + F.coalesce(large, zero)).cast(WIDE)


def population_variance(n: Column, total: Column, squares: Column) -> Column:
    """(n*sum(x^2) - sum(x)^2) / n^2 with an exact numerator.

    Equals E[x^2] - E[x]^2 without its cancellation: never negative, and 0 only for a constant.
    """
    count = n.cast("decimal(20,0)")
    spread = count * squares.cast(WIDE) - total.cast(WIDE) * total.cast(WIDE)
    return spread.cast("double") / (n.cast("double") * n.cast("double"))


def times_deviation(diff: Column, variance: Column) -> Column:
    """diff / sqrt(variance), NULL where the variance is 0."""
    return F.try_divide(diff, F.sqrt(variance))


def epanechnikov(u: Column) -> Column:
    """3/4 (1 - u^2) inside [-1, 1], 0 outside."""
    return F.when(F.abs(u) > 1, F.lit(0.0)).otherwise((1 - u * u) * 0.75)
