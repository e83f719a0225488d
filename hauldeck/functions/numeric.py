"""Rounding and averaging helpers shared by every operator.

Sums run over decimals (exact, so independent of the partitioning); the
division is done once in double and the quotient is rounded through
decimal(38,10), half away from zero.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def rnd(c, digits: int = 2) -> Column:
    """Round half up without binary noise; the result is a double."""
    return F.round(_col(c).cast("decimal(38,10)"), digits).cast("double")


def davg(c) -> Column:
    """Mean as exact sum / non-null count, in double."""
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def avg2(c, digits: int = 2) -> Column:
    return rnd(davg(c), digits)


def sum2(c, digits: int = 2) -> Column:
    return rnd(F.sum(_col(c)), digits)


def count_when(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


def share(cond: Column) -> Column:
    """Percentage of all rows (NULL rows included in the denominator)."""
    return F.try_divide(count_when(cond).cast("double") * 100, F.count(F.lit(1)).cast("double"))


def on_time_rate(digits: int = 2) -> Column:
    return rnd(share(F.col("eta_met") == 1), digits)


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))
