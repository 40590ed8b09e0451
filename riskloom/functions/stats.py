"""Closed-form statistics as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: two-sided 95 % normal quantile.
Z = 1.959963984540054


def rate(successes: Column, total: Column) -> Column:
    """Null where there is nothing to rate."""
    return F.when(total > 0, F.round(successes / total, 4))


def wilson_low(successes: Column, total: Column) -> Column:
    return _wilson(successes, total, -1)


def wilson_high(successes: Column, total: Column) -> Column:
    return _wilson(successes, total, 1)


def _wilson(successes: Column, total: Column, sign: int) -> Column:
    """An end of the 95 % Wilson interval, exactly 0 and 1 at the extremes, null without data; rounded to 4 places."""
    n = total.cast("double")
    share = successes / n
    whole = 1 + F.lit(Z * Z) / n
    centre = (share + F.lit(Z * Z) / (2 * n)) / whole
    margin = F.lit(Z) * F.sqrt(share * (1 - share) / n + F.lit(Z * Z) / (4 * n * n)) / whole
    if sign < 0:
        value = F.when(successes == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - margin))
    else:
        value = F.when(successes == total, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + margin))
    return F.when(total > 0, F.round(value, 4))
