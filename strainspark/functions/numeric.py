"""Numbers: transforms that never divide by zero or take the logarithm of zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(x: Column, y: Column) -> Column:
    """x / y as a double, null where y is 0."""
    return F.try_divide(x.cast("double"), y.cast("double"))


def log2p1(x: Column) -> Column:
    return F.log2(x + 1)


def logit(p: Column) -> Column:
    """ln(p / (1 - p)), null outside (0, 1)."""
    return F.when((p > 0) & (p < 1), F.log(p / (1 - p)))


def log2_or_null(x: Column) -> Column:
    return F.when(x > 0, F.log2(x))


def minus_log10(p: Column) -> Column:
    return F.when(p > 0, -F.log10(p))


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def is_bad(x: Column) -> Column:
    """Null, NaN, infinite, empty, or one of the words na, nan and null."""
    text = F.lower(F.trim(x.cast("string")))
    return x.isNull() | text.isin("", "na", "nan", "null", "inf", "-inf", "infinity", "-infinity")


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays, null if either is zero."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda i, j: i.cast("double") * j.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))
