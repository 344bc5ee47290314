"""The N items of greatest score in every group, always the same ones.

Items are named by their tie columns (numbers); an item may have several rows and scores as its
greatest valid one. Order: score descending, then the tie columns ascending: a total order of items,
so that the result depends neither on the order nor on the number of rows.

Plan: (1) each partition keeps, per group, its own N best items in that order; all its other rows lie below
its N-th best and are dropped where they are read. At least N items are as good as that one, so that (2) it is a
lower bound of the group's N-th best. What is kept, at most N items per group and partition however large the
group, is shuffled by group, once; (3) the greatest bound of each group, whatever their number, is joined
to its rows by a window over that partitioning, and rows below it are dropped; (4) survivors are reduced to one row
per item and ranked. A partition of very many groups hands on what it holds once ``most_groups`` are open and
begins anew, so that its memory is bounded; each part gives valid bounds of its own.

Defined results: rows of null group key, null tie column, or a score that is null, NaN or outside
``lowest..highest`` do not take part; a group of fewer than N items gives all; equal scores are ordered
by the tie columns, never cut at random; repeated rows change nothing; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _best(code: np.ndarray, score: np.ndarray, ties: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n best items of each code, in order, and their ranks from 0."""
    by_item = np.lexsort((-score, *ties[::-1], code))  # the best row of an item comes first
    same = np.ones(len(by_item), bool)
    same[:1] = False
    for values in (code, *ties):
        v = values[by_item]
        same[1:] &= v[1:] == v[:-1]
    items = by_item[~same]
    items = items[np.lexsort((*(t[items] for t in ties[::-1]), -score[items], code[items]))]
    c = code[items]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.zeros(0, int)
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
    return items[rank < n], rank[rank < n]


def _local_tops(n: int, keys: int, ties: int, most_groups: int):
    """Batches of (keys, score, ties) -> the n best items of each group of the partition, with their places from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        worst = np.zeros(0)  # score of the N-th item so far
        none: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0), *(np.zeros(0, np.int64) for _ in range(ties))]
        held, waiting, waits = none, [], 0
        rank = np.zeros(0, np.int64)

        def settle() -> None:
            nonlocal held, rank, waiting, waits
            code, score, *tie = (np.concatenate([h, *(w[i] for w in waiting)]) for i, h in enumerate(held))
            keep, rank = _best(code, score, tie, n)
            held = [code[keep], score[keep], *(t[keep] for t in tie)]
            full = rank == n - 1
            worst[held[0][full]] = held[1][full]
            waiting, waits = [], 0

        def handed_on() -> pa.RecordBatch:
            settle()
            names = list(codes)
            made = [*(pa.array([g[i] for g in names], pa.string()).take(pa.array(held[0])) for i in range(keys)), *(pa.array(h) for h in held[1:]), pa.array(rank + 1)]
            return pa.RecordBatch.from_arrays(made, names=[*(f"k{i}" for i in range(keys)), "score", *(f"t{i}" for i in range(ties)), "place"])

        for batch in batches:
            if not batch.num_rows:
                continue
            mixed, parts = np.zeros(batch.num_rows, np.int64), []
            for i in range(keys):
                d = batch.column(i).dictionary_encode()
                mixed = mixed * max(1, len(d.dictionary)) + d.indices.to_numpy(zero_copy_only=False)
                parts.append(d.dictionary.to_pylist())
            distinct, at = np.unique(mixed, return_inverse=True)
            local = []
            for m in distinct.tolist():
                name = []
                for p in reversed(parts):
                    m, r = divmod(m, max(1, len(p)))
                    name.append(p[r])
                local.append(codes.setdefault(tuple(reversed(name)), len(codes)))
            if len(codes) > len(worst):
                worst = np.r_[worst, np.full(max(1024, len(codes)), -np.inf)]
            code = np.array(local, np.int64)[at]
            score = batch.column(keys).to_numpy(zero_copy_only=False)
            keep = score >= worst[code]
            waiting.append([code[keep], score[keep], *(batch.column(keys + 1 + i).to_numpy(zero_copy_only=False)[keep] for i in range(ties))])
            waits += int(keep.sum())
            if len(codes) > most_groups:
                yield handed_on()
                codes, worst, held = {}, np.zeros(0), none
            elif waits > max(50_000, 2 * len(held[0])):
                settle()
        if codes:
            yield handed_on()

    return run


def _not_below(bound: Column, ties: list[str]) -> Column:
    """Whether a row is not below the bound (score, negative ties) of its group; there may be none."""
    good = F.lit(True)
    for i, t in reversed(list(enumerate(ties))):
        good = (-F.col(t) > bound[f"n{i}"]) | ((-F.col(t) == bound[f"n{i}"]) & good)
    return bound.isNull() | (F.col("score") > bound["score"]) | ((F.col("score") == bound["score"]) & good)


def top_per_group(df: DataFrame, keys: dict[str, Column], score: str, ties: list[str], n: int, lowest: float, highest: float, most_groups: int = 100_000, required: tuple[str, ...] = ()) -> DataFrame:
    """Columns: the keys (as text, by the names in ``keys``), the tie columns, ``score`` and ``rank`` from 1.

    Rows of null key are left out. ``required`` may name the columns of ``df`` that decide it (a key is null exactly if
    one of them is): they are then tested instead of the keys, which else are made twice, for the test and for use."""
    if len({*keys, *ties, "score", "rank"}) < len(keys) + len(ties) + 2:
        raise ValueError("the names of keys and tie columns must differ, also from score and rank")
    k, t = [f"k{i}" for i in range(len(keys))], [f"t{i}" for i in range(len(ties))]
    valid = df.where(F.col(score).between(lowest, highest) & ~F.isnan(score)).dropna(subset=[*ties, *required])
    rows = valid.select(*(c.cast("string").alias(a) for a, c in zip(k, keys.values(), strict=True)), F.col(score).cast("double").alias("score"), *(F.col(c).cast("bigint").alias(a) for a, c in zip(t, ties, strict=True)))
    rows = rows if required else rows.dropna(subset=k)
    schema = T.StructType([*(T.StructField(a, T.StringType()) for a in k), T.StructField("score", T.DoubleType()), *(T.StructField(a, T.LongType()) for a in t), T.StructField("place", T.LongType())])
    tops = rows.mapInArrow(_local_tops(n, len(k), len(t), most_groups), schema)
    item = F.struct("score", *((-F.col(a)).alias(f"n{i}") for i, a in enumerate(t)))
    bounded = tops.withColumn("bound", F.max(F.when(F.col("place") == n, item)).over(W.partitionBy(*k)))
    items = bounded.where(_not_below(F.col("bound"), t)).groupBy(*k, *t).agg(F.max("score").alias("score"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy(*k).orderBy(F.desc("score"), *t))).where(F.col("rank") <= n)
    kinds = {f.name: f.dataType for f in df.schema}
    return ranked.select(*(F.col(a).alias(name) for a, name in zip(k, keys, strict=True)), *(F.col(a).cast(kinds[c]).alias(c) for a, c in zip(t, ties, strict=True)), "score", "rank")
