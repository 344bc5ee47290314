"""Keeps labels out of features: by lineage and by schema."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridloom.sources.schema import BANNED, FEATURES


class LeakageError(ValueError):
    """Features were made from label data."""


def assert_no_leakage(features: DataFrame, label_tables: tuple[str, ...] = ("irmap",), label_columns: tuple[str, ...] = ("drop_v", "label_v")) -> DataFrame:
    """The frame itself, if none of its input files belongs to a label table and none of its columns is a label or
    banned. ``inputFiles`` needs no job."""
    files = [f for f in features.inputFiles() for t in label_tables if f"/{t}." in f or f"/{t}/" in f]
    columns = [c for c in features.columns if c in (*label_columns, *BANNED)]
    if files or columns:
        raise LeakageError(f"label data reach the features: files {files[:3]}, columns {columns}")
    return features


def feature_faults(features: DataFrame) -> DataFrame:
    """Feature columns with values that are null, NaN or infinite: feature, n."""
    from pyspark.sql import functions as F

    bad = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    sums = features.agg(*(bad(c).alias(c) for c in FEATURES))
    return sums.unpivot([], FEATURES, "feature", "n").where("n > 0")
