"""Numeric helpers: half-even rounding, guarded shares."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double, 0.0 when there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def percentage(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.bround(share(part, whole) * 100, digits)


def count_true(flag: Column) -> Column:
    return F.count_if(F.coalesce(flag, F.lit(False)))


def any_true(flag: Column) -> Column:
    return F.coalesce(F.bool_or(flag), F.lit(False))
