"""Conformal correction of quantile bands, calibrated on the calibration partition only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import ratio
from gridloom.operators.ranking import order_statistic


def level(n: Column, alpha: float) -> Column:
    """Finite-sample level of the order statistic."""
    return F.least(F.lit(1.0), F.ceil(F.round((n + 1) * (1 - alpha), 9)) / n)


def conformal_shift(df: DataFrame, keys: list[str], label: str, low: str, high: str, alpha: float = 0.2, relative: bool = False, spread: bool = True) -> DataFrame:
    """The additive shift (or the one relative to the band's width) that covers ``1 - alpha`` of a calibration set:
    keys, shift, n. ``spread``: see :mod:`gridloom.operators.ranking`; for few keys with many rows each."""
    miss = F.greatest(F.col(low) - F.col(label), F.col(label) - F.col(high))
    scores = df.select(*keys, (ratio(miss, F.col(high) - F.col(low)) if relative else miss).alias("e")).dropna(subset=["e"])
    return order_statistic(scores, keys, "e", lambda n: level(n, alpha), "shift", spread)


def apply_shift(low: Column, high: Column, shift: Column) -> tuple[Column, Column]:
    return low - shift, high + shift


def monotone(low: Column, pred: Column, high: Column) -> tuple[Column, Column]:
    """A band that holds the prediction."""
    return F.least(low, pred), F.greatest(high, pred)
