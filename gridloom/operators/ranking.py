"""Ranks, order statistics and curves by score.

Groups of bounded size (a design's grid) are ranked by a window over the group. Where a group may hold any share of
all rows (a scenario, a feature, the whole corpus), ``spread=True`` parts its values into ranges: cuts from
mergeable percentile sketches, row counts of the ranges, and a window within each range only, to which the count
of all rows before it is added. A value so frequent that several cuts fall on it is a range of its own and needs no
sorting at all. What reaches the driver is ``MOST_KEYS`` times ``MOST_RANGES`` numbers at most, by check; the
groups then have few keys. The rows are read once for the cuts, once for the counts and once for the result, so
that callers stage what is dear to make; ``df`` must give the same rows each time.

Nulls come first in order, NaN last. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_RANGES, MOST_RANGES, MOST_KEYS = 8, 4096, 1000


class Ranges:
    """The values of a column, parted by key into ranges of about equal numbers of rows."""

    def __init__(self, df: DataFrame, keys: list[str], value: str, ranges: int | None = None) -> None:
        spark = df.sparkSession
        n = ranges or min(MOST_RANGES, max(LEAST_RANGES, int(spark.conf.get("spark.sql.shuffle.partitions"))))
        self.keys, self.value, self.step = keys, value, math.isqrt(n) + 1
        sketch = F.percentile_approx(value, [i / n for i in range(1, n)], F.lit(10 * n))
        got = df.groupBy(*keys).agg(sketch.alias("cuts")).limit(MOST_KEYS + 1).collect()
        if len(got) > MOST_KEYS:
            raise ValueError(f"more than {MOST_KEYS} groups: rank them by a window each")
        rows = [(*(r[k] for k in keys), c := r["cuts"] or [], c[self.step - 1 :: self.step]) for r in got]
        kind = T.ArrayType(df.schema[value].dataType)
        fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
        self.cuts = spark.createDataFrame(rows, T.StructType([*fields, T.StructField("_cuts", kind), T.StructField("_coarse", kind)]))
        self.frequent = any(a == b for r in got for a, b in zip(r["cuts"] or [], (r["cuts"] or [])[1:], strict=False))
        counts = self._bucketed(df).groupBy(*keys, "_bucket").count().collect()  # two a range at most
        groups: dict[tuple, list] = {}
        for r in sorted(counts, key=lambda r: r["_bucket"]):
            groups.setdefault(tuple(r[k] for k in keys), []).append((r["_bucket"], r["count"]))
        table = []
        for key, parts in groups.items():
            total, before = sum(c for _, c in parts), 0
            for b, c in parts:
                table.append((*key, b, before, c, total))
                before += c
        numbers = [T.StructField("_bucket", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("_before", "_in", "_total"))]
        self.places = spark.createDataFrame(table, T.StructType([*fields, *numbers]))

    def _beside(self, df: DataFrame, small: DataFrame, by: list[str]) -> DataFrame:
        """Joined with one of the small tables, whose size is bounded; null keys are a group."""
        named = small.withColumnsRenamed({k: f"_k_{k}" for k in by})
        same = F.lit(True)
        for k in by:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        return df.join(F.broadcast(named), same).drop(*(f"_k_{k}" for k in by))

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """With ``_bucket``: twice the number of cuts below the value, odd where it is a value of several cuts."""
        v = F.col(self.value)
        below = lambda cuts: F.size(F.filter(cuts, lambda c: c < v))
        found = self._beside(df, self.cuts, self.keys).withColumn("_at", F.when(v.isNull(), 0).otherwise(below(F.col("_coarse")) * self.step))
        found = found.withColumn("_at", F.when(v.isNull(), 0).otherwise(F.col("_at") + below(F.slice("_cuts", F.col("_at") + 1, F.lit(self.step)))))
        often = F.coalesce((F.get("_cuts", F.col("_at")) == v) & (F.get("_cuts", F.col("_at") + 1) == v), F.lit(False))
        return found.withColumn("_bucket", (2 * F.col("_at") + often.cast("int")).cast("int")).drop("_cuts", "_coarse", "_at")

    def placed(self, df: DataFrame) -> DataFrame:
        """With ``_bucket``, the rows of lower ranges ``_before`` it, those ``_in`` it and the group's ``_total``."""
        return self._beside(self._bucketed(df), self.places, [*self.keys, "_bucket"])

    def within(self) -> W:
        return W.partitionBy(*self.keys, "_bucket")

    def split(self, df: DataFrame, sorted_: Callable[[DataFrame], DataFrame], alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Ranges that are sorted, and those of one frequent value, each in its own way."""
        if not self.frequent:
            return sorted_(df)
        return sorted_(df.where("_bucket % 2 = 0")).unionByName(alike(df.where("_bucket % 2 = 1")))


MADE = ("_bucket", "_before", "_in", "_total")


def average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank", relative: bool = False, spread: bool = False, ranges: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """Rank from 1 within the group, ties sharing their average; ``relative`` divides by the group's size. ``of``: the same
    rows where they are cheaper to read for the ranges."""
    if not spread:
        by, ties = W.partitionBy(*keys).orderBy(value), W.partitionBy(*keys, value)
        rank = F.rank().over(by) + (F.count("*").over(ties) - 1) / 2
        return df.withColumn(name, rank / F.count("*").over(W.partitionBy(*keys)) if relative else rank)
    r = Ranges(df if of is None else of, keys, value, ranges)
    by, size = r.within().orderBy(value), F.col("_total") if relative else F.lit(1)
    rank = F.col("_before") + F.rank().over(by) + (F.count("*").over(by.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2
    out = r.split(r.placed(df), lambda d: d.withColumn(name, rank / size), lambda d: d.withColumn(name, (F.col("_before") + (F.col("_in") + 1) / 2) / size))
    return out.drop(*MADE)


def order_statistic(df: DataFrame, keys: list[str], value: str, level: Callable[[Column], Column] | float, name: str = "q", spread: bool = False, ranges: int | None = None) -> DataFrame:
    """The value at the next higher place of a quantile: row ``ceil((n - 1) * level) + 1`` in order. ``level`` may be
    made from the number of rows."""
    at = lambda n: F.ceil(F.round((n - 1) * (level(n) if callable(level) else F.lit(float(level))), 9)) + 1
    if not spread:
        by = W.partitionBy(*keys).orderBy(value)
        ranked = df.withColumn("_r", F.row_number().over(by)).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
        return ranked.where(F.col("_r") == at(F.col("_n"))).select(*keys, F.col(value).alias(name), F.col("_n").alias("n"))
    r = Ranges(df, keys, value, ranges)
    # only the range that holds the place is sorted
    held = r.placed(df.select(*keys, value)).withColumn("_r", at(F.col("_total"))).where("_before < _r and _r <= _before + _in")
    pick = lambda d: d.withColumn("_o", F.row_number().over(r.within().orderBy(value))).where("_o = _r - _before").select(*keys, value, "_total")
    any_ = lambda d: d.groupBy(*keys, "_total").agg(F.min(value).alias(value)).select(*keys, value, "_total")
    return r.split(held, pick, any_).select(*keys, F.col(value).alias(name), F.col("_total").alias("n"))


def precision_recall(df: DataFrame, keys: list[str], label: str, score: str, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """Precision and recall at each distinct score, from the highest: scores are grouped before they are ordered."""
    scores = df.groupBy(*keys, score).agg(F.count_if(label).alias("_p"), F.count("*").alias("_n"))
    if spread:
        r = Ranges(df, keys, score, ranges)
        ranged = r.placed(scores)  # each score once: no range is of one frequent value only
        by, some = [*keys, "_bucket"], ranged.groupBy(*keys, "_bucket").agg(F.sum("_p").alias("_bp"), F.sum("_n").alias("_bn"))
        above = W.partitionBy(*keys).orderBy(F.desc("_bucket")).rowsBetween(W.unboundedPreceding, -1)  # a row a range
        every = W.partitionBy(*keys)
        some = some.select(*by, F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_ap"), F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_an"), F.sum("_bp").over(every).alias("positives"))
        upto = r.within().orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
        run = r._beside(ranged, some, by).withColumn("tp", F.col("_ap") + F.sum("_p").over(upto)).withColumn("taken", F.col("_an") + F.sum("_n").over(upto))
    else:
        upto = W.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, 0)
        run = scores.withColumn("tp", F.sum("_p").over(upto)).withColumn("taken", F.sum("_n").over(upto)).withColumn("positives", F.sum("_p").over(W.partitionBy(*keys)))
    share = F.when(F.col("positives") > 0, F.col("tp") / F.when(F.col("positives") > 0, F.col("positives")))
    return run.select(*keys, F.col(score).alias("threshold"), (F.col("tp") / F.col("taken")).alias("precision"), share.alias("recall"), "tp", "taken", "positives", F.col("_p").alias("hits"))


def average_precision(df: DataFrame, keys: list[str], label: str, score: str, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """Area under the precision-recall steps (each of its hits over all positives); null where all labels are alike."""
    curve = precision_recall(df, keys, label, score, spread, ranges)
    step = F.col("hits") / F.when(F.col("positives") > 0, F.col("positives"))
    by = curve.withColumn("_a", step * F.col("precision")).groupBy(*keys).agg(F.sum("_a").alias("_ap"), F.max("positives").alias("positives"), F.max("taken").alias("n"))
    return by.select(*keys, F.when((F.col("positives") > 0) & (F.col("positives") < F.col("n")), F.col("_ap")).alias("average_precision"), "positives", "n")


def _among_first(df: DataFrame, r: Ranges, name: str, count: Column, tie: list[str]) -> DataFrame:
    """``name``: whether a row is among the first by value descending, then ``tie``. Only the range in which the count is
    reached is sorted."""
    above = F.col("_total") - F.col("_before") - F.col("_in")
    placed = r.placed(df).withColumn("_c", count).withColumn("_above", above)
    edge = (F.col("_above") < F.col("_c")) & (F.col("_above") + F.col("_in") > F.col("_c"))
    order = r.within().orderBy(F.desc(r.value), *tie)
    mixed = placed.where(edge).withColumn(name, F.col("_above") + F.row_number().over(order) <= F.col("_c"))
    clear = placed.where(~edge).withColumn(name, F.col("_above") < F.col("_c"))
    return clear.unionByName(mixed).drop(*MADE, "_c", "_above")


def top_share_hit(df: DataFrame, keys: list[str], label: str, score: str, tie: list[str], share: float = 0.05, spread: bool = False, ranges: int | None = None) -> DataFrame:
    """Overlap of the items of greatest label and greatest score, as a share of k = max(1, share of n, half to even)."""
    size = lambda n: F.greatest(F.lit(1), F.bround(n * share).cast("int"))
    if spread:
        df = df.select(*keys, label, score, *tie)
        first, second = Ranges(df, keys, label, ranges), Ranges(df, keys, score, ranges)
        both = _among_first(_among_first(df, first, "_a", size(F.col("_total")), tie), second, "_b", size(F.col("_total")), tie)
        by = both.groupBy(*keys).agg(F.count_if(F.col("_a") & F.col("_b")).alias("_hit"), size(F.count("*")).alias("k"))
        return by.select(*keys, (F.col("_hit") / F.col("k")).alias("top_hit"), "k")
    every = W.partitionBy(*keys)
    ranked = df.withColumn("_k", size(F.count("*").over(every))).withColumn("_a", F.row_number().over(every.orderBy(F.desc(label), *tie))).withColumn("_b", F.row_number().over(every.orderBy(F.desc(score), *tie)))
    return ranked.groupBy(*keys).agg((F.count_if((F.col("_a") <= F.col("_k")) & (F.col("_b") <= F.col("_k"))) / F.max("_k")).alias("top_hit"), F.max("_k").alias("k"))


def demeaned(df: DataFrame, keys: list[str], value: str, name: str = "centred") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.avg(value).over(W.partitionBy(*keys)))
