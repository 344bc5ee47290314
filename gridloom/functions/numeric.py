"""Number columns with the edge cases the analytics define."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(col: Column | str) -> Column:
    """The number, or null where it is NaN."""
    col = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(col), col)


def ratio(num: Column, den: Column, otherwise: float | None = None) -> Column:
    """num / den where den > 0, else ``otherwise`` (null by default). Never raises."""
    return F.when(den > 0, num / F.when(den > 0, den)).otherwise(F.lit(otherwise))


def clip(col: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.least(F.greatest(col, lit(low)), lit(high))


def tile(position: Column, size: Column | float, n: int) -> Column:
    """Index of the tile that holds a position, of n tiles over ``size``; truncated, then clipped to the die."""
    size = size if isinstance(size, Column) else F.lit(float(size))
    return clip((position / (size / n)).cast("int"), F.lit(0), F.lit(n - 1))


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation; null where either column is constant."""
    return F.when((F.stddev_pop(x) > 1e-15) & (F.stddev_pop(y) > 1e-15), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))
