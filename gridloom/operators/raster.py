"""From points and rectangles to tiles, from fine tiles to coarse ones."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.numeric import clip, ratio, tile


def with_tiles(df: DataFrame, x: str, y: str, die_w: Column | float, die_h: Column | float, n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Adds the tile of each point on an n by n grid."""
    return df.withColumn(ty, tile(F.col(y), die_h, n)).withColumn(tx, tile(F.col(x), die_w, n))


def tile_id(ty: Column, tx: Column, n: int) -> Column:
    return ty * n + tx


def tile_of_id(tile_id: Column, n: int) -> tuple[Column, Column]:
    return (tile_id / n).cast("int"), (tile_id % n).cast("int")


def full_grid(keys: DataFrame, n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Every tile of every key row: each row is exploded, nothing is joined."""
    cells = keys.withColumn("_cell", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    return cells.withColumn(ty, F.expr(f"cast(_cell div {n} as int)")).withColumn(tx, (F.col("_cell") % n).cast("int")).drop("_cell")


def scatter_add(points: DataFrame, keys: list[str], weights: dict[str, Column]) -> DataFrame:
    """Sum of each weight per key and tile; tiles without points are absent."""
    return points.groupBy(*keys).agg(*(F.sum(w).alias(n) for n, w in weights.items()))


def densify(sparse: DataFrame, grid: DataFrame, keys: list[str], fill: float = 0.0) -> DataFrame:
    """One row per tile of the grid; absent values become ``fill``."""
    values = [c for c in sparse.columns if c not in keys]
    return grid.join(sparse, keys, "left").fillna(fill, subset=values)


def gathered(sparse: DataFrame, every: DataFrame, keys: list[str], n: int, values: list[str], fill: float = 0.0) -> DataFrame:
    """``keys`` and an array of the n * n tiles for each of ``values``, one row per key of ``every``. ``sparse`` has one row
    a tile; absent and null values become ``fill``. Only tiles that are there are shuffled, and nothing is joined: a join
    with the exploded grid would move n * n rows a key, which the planner takes for one."""
    held = F.struct((F.col("ty") * n + F.col("tx")).cast("int").alias("p"), *(F.col(c).cast("double").alias(c) for c in values))
    inside = sparse.where(f"ty between 0 and {n - 1} and tx between 0 and {n - 1}").select(*keys, F.lit(False).alias("_e"), held.alias("_s"))
    rows = every.select(*keys, F.lit(True).alias("_e"), F.lit(None).cast(inside.schema["_s"].dataType).alias("_s")).unionByName(inside)
    maps = rows.groupBy(*keys).agg(F.max("_e").alias("_e"), F.collect_list("_s").alias("_s")).where("_e").select(*keys, "_s")
    schema = T.StructType([*(maps.schema[k] for k in keys), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in values)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                lists, tiles = batch.column(len(keys)), batch.column(len(keys)).flatten()
                at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False)) * (n * n) + tiles.field("p").to_numpy()
                made = []
                for c in values:
                    grid = np.full(batch.num_rows * n * n, fill)
                    v = tiles.field(c).to_numpy(zero_copy_only=False)
                    grid[at] = np.where(np.isnan(v), fill, v)
                    made.append(pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * (n * n)), pa.array(grid)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=schema.names)

    return maps.mapInArrow(run, schema)


def tiles_of(grids: DataFrame, keys: list[str], n: int, values: list[str]) -> DataFrame:
    """One row per tile of arrays as made by :func:`gathered`."""
    out = grids.select(*keys, F.posexplode(F.arrays_zip(*values)).alias("_p", "_z"))
    return out.select(*keys, F.expr(f"cast(_p div {n} as int)").alias("ty"), (F.col("_p") % n).cast("int").alias("tx"), *(F.col("_z")[c].alias(c) for c in values))


def block_reduce(fine: DataFrame, keys: list[str], value: str, r: int, fy: str = "fy", fx: str = "fx", tiled: bool = False) -> DataFrame:
    """Mean, least and greatest fine value of each r by r block: ``ty, tx, v_mean, v_min, v_max, n_cells``. ``tiled``: the
    rows have their ``ty, tx`` (and perhaps a partitioning by them)."""
    blocks = fine if tiled else fine.withColumn("ty", F.expr(f"cast({fy} div {r} as int)")).withColumn("tx", F.expr(f"cast({fx} div {r} as int)"))
    return blocks.groupBy(*keys, "ty", "tx").agg(F.avg(value).alias("v_mean"), F.min(value).alias("v_min"), F.max(value).alias("v_max"), F.count(value).alias("n_cells"))


def covered_tiles(rects: DataFrame, die_w: Column | float, die_h: Column | float, n: int, x0: str = "x0_um", y0: str = "y0_um", x1: str = "x1_um", y1: str = "y1_um") -> DataFrame:
    """Each rectangle with every tile it touches (last tile included) and their number: an explode, not a range join."""
    at = lambda c, size: tile(F.col(c), size, n)
    spans = rects.withColumn("_ys", F.sequence(at(y0, die_h), F.greatest(at(y1, die_h), at(y0, die_h)))).withColumn("_xs", F.sequence(at(x0, die_w), F.greatest(at(x1, die_w), at(x0, die_w))))
    counted = spans.withColumn("n_tiles", F.size("_ys") * F.size("_xs"))
    return counted.withColumn("ty", F.explode("_ys")).withColumn("tx", F.explode("_xs")).drop("_ys", "_xs")


def coverage(rects: DataFrame, keys: list[str], die_w: Column | float, die_h: Column | float, n: int, sub: int = 16, x0: str = "x0_um", y0: str = "y0_um", x1: str = "x1_um", y1: str = "y1_um") -> DataFrame:
    """Share of each tile under the union of rectangles, on sub by sub (62 at most) cells a tile; overlaps count once.
    Edges are half open: floor of the lower, ceiling of the upper."""
    m = n * sub
    size = lambda s: s if isinstance(s, Column) else F.lit(float(s))
    low = lambda c, s: clip(F.floor(F.col(c) / (size(s) / m)).cast("int"), 0, m)
    high = lambda c, s: clip(F.ceil(F.col(c) / (size(s) / m)).cast("int"), 0, m)
    spans = rects.select(*keys, low(y0, die_h).alias("_a"), high(y1, die_h).alias("_b"), low(x0, die_w).alias("_c"), high(x1, die_w).alias("_d")).where("_b > _a and _d > _c")
    # a row of sub-cells within a tile is one number of ``sub`` bits, and a union is the bits' union
    rows = spans.withColumn("_y", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1))).withColumn("tx", F.explode(F.expr(f"sequence(_c div {sub}, (_d - 1) div {sub})").cast("array<int>")))
    bits = F.expr(f"shiftleft(1L, least(_d - tx * {sub}, {sub})) - shiftleft(1L, greatest(_c - tx * {sub}, 0))")
    cells = rows.groupBy(*keys, "tx", "_y").agg(F.bit_count(F.bit_or(bits)).alias("_n"))
    return cells.groupBy(*keys, F.expr(f"cast(_y div {sub} as int)").alias("ty"), "tx").agg((F.sum("_n") / float(sub * sub)).alias("covered"))


def densities(points: DataFrame, keys: list[str], tile_area: Column | float) -> DataFrame:
    """Cell statistics per tile: count, area and capacitance per area, share of clock and sequential cells (0 in empty tiles)."""
    area = tile_area if isinstance(tile_area, Column) else F.lit(float(tile_area))
    sums = points.groupBy(*keys).agg(F.count("*").alias("cells"), F.sum("area_um2").alias("_area"), F.sum("cap_ff").alias("_cap"), F.sum("is_clk").alias("_clk"), F.sum("is_seq").alias("_seq"))
    return sums.select(*keys, "cells", (F.col("_area") / area).alias("util"), (F.col("_cap") / area).alias("capden"), ratio(F.col("_clk").cast("double"), F.col("cells"), 0.0).alias("clkden"), ratio(F.col("_seq").cast("double"), F.col("cells"), 0.0).alias("seqden"))


def edge_distance(ty: Column, tx: Column, n: int) -> Column:
    return F.least(ty, tx, F.lit(n - 1) - ty, F.lit(n - 1) - tx)


def upsampled(coarse: DataFrame, r: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Each coarse value at its r * r fine cells."""
    cells = coarse.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(r * r - 1))))
    return cells.withColumn("fy", F.expr(f"cast({ty} * {r} + _c div {r} as int)")).withColumn("fx", (F.col(tx) * r + F.col("_c") % r).cast("int")).drop("_c")


def area_downsample(matrix: DataFrame, keys: list[str], value: str, size: int, n: int) -> DataFrame:
    """N x N values (columns y, x) averaged to n x n with the edges ``floor(i * size / n)``."""
    at = lambda c: F.expr(f"cast(((({c} + 1) * {n} + {size} - 1) div {size}) - 1 as int)")
    return matrix.withColumn("ty", at("y")).withColumn("tx", at("x")).groupBy(*keys, "ty", "tx").agg(F.avg(value).alias(value))
