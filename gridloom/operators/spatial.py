"""Neighbourhoods on tile grids: blurs, distances, nearest values, rings."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import stage



def gaussian_weights(sigma: float) -> list[float]:
    """Weights of the offsets -r..r of a Gaussian cut at four sigma."""
    r = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-r, r + 1)]
    return [w / sum(raw) for w in raw]


def blur_matrix(sigma: float, n: int) -> np.ndarray:
    """The blur of a line of n cells as a matrix; places beyond the edge are mirrored (d c b a | a b c d | d c b a)."""
    weights = gaussian_weights(sigma)
    r, m = len(weights) // 2, np.zeros((n, n))
    for d, w in zip(range(-r, r + 1), weights, strict=True):
        at = (np.arange(n) + d) % (2 * n)
        np.add.at(m, (np.arange(n), np.where(at < n, at, 2 * n - 1 - at)), w)
    return m


def gaussian_blurs(df: DataFrame, keys: list[str], value: str, sigmas: dict[str, float], n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Blurred maps of a full n by n grid, a column for each of ``sigmas``. The n * n values of a map are gathered
    into one array (its size is the grid's, whatever the data); batches of maps are blurred by two matrix products."""
    matrices = {name: blur_matrix(s, n) for name, s in sigmas.items()}
    maps = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((F.col(ty) * n + F.col(tx)).alias("p"), F.col(value).alias("v")))).alias("_m")).select(*keys, F.transform("_m", lambda x: x["v"]).alias("_v"))
    schema = T.StructType([*(maps.schema[k] for k in keys), *(T.StructField(name, T.ArrayType(T.DoubleType())) for name in sigmas)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grids = batch.column(len(keys)).flatten().to_numpy().reshape(-1, n, n)
            ends = pa.array(np.arange(len(grids) + 1, dtype=np.int32) * (n * n))
            made = [pa.ListArray.from_arrays(ends, pa.array((m @ grids @ m.T).ravel())) for m in matrices.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=schema.names)

    out = maps.mapInArrow(run, schema).select(*keys, F.posexplode(F.arrays_zip(*sigmas)).alias("_p", "_z"))
    return out.select(*keys, F.expr(f"cast(_p div {n} as int)").alias(ty), (F.col("_p") % n).alias(tx), *(F.col("_z")[name].alias(name) for name in sigmas))


def gaussian_blur(df: DataFrame, keys: list[str], value: str, sigma: float, n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    return gaussian_blurs(df, keys, value, {value: sigma}, n, ty, tx)


def grid_distances(held: np.ndarray) -> np.ndarray:
    """Euclidean distance of every cell of a square grid to the nearest one held: exact and separable, by distances along
    rows, then the least over each column, as far as any cell can still gain. Squares are whole numbers, which short floats hold exactly up to 2 ** 24."""
    n = len(held)
    kind = np.float32 if 2 * n * n < 2**24 else np.float64
    i = np.arange(n, dtype=kind)
    at = np.where(held, kind(0), kind(np.inf))
    before, after = np.minimum.accumulate(at - i, axis=1) + i, np.minimum.accumulate((at + i)[:, ::-1], axis=1)[:, ::-1] - i
    squares = np.square(np.minimum(before, after))
    best, further = squares.copy(), squares.copy()
    for d in range(1, n):
        if d % 4 == 1 and d * d >= best.max():
            break
        further += kind(2 * d - 1)  # squares and d * d
        np.minimum(best[d:], further[:-d], out=best[d:])
        np.minimum(best[:-d], further[d:], out=best[:-d])
    return np.sqrt(best, dtype=float)


def distance_transform(points: DataFrame, keys: list[str], n: int, none: float, ty: str = "fy", tx: str = "fx", name: str = "d") -> DataFrame:
    """Euclidean distance of every cell of an n by n grid to the nearest of the points (``py, px``; rows of null
    place only name a key). A group is at most one grid; see :func:`grid_distances`."""
    schema = T.StructType([*(points.schema[k] for k in keys), T.StructField(ty, T.IntegerType()), T.StructField(tx, T.IntegerType()), T.StructField(name, T.DoubleType())])

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        held = rows.drop_null()
        at = np.zeros((n, n), bool)
        at[held.column("py").to_numpy(), held.column("px").to_numpy()] = True
        d = grid_distances(at) if len(held) else np.full((n, n), none)
        y, x = np.divmod(np.arange(n * n, dtype=np.int32), n)
        return pa.table([*(pa.array([k.as_py()] * (n * n)).cast(k.type) for k in key), pa.array(y), pa.array(x), pa.array(d.ravel())], names=schema.names)

    return points.select(*keys, F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px")).distinct().groupBy(*keys).applyInArrow(run, schema)


def nearest_distance(cells: DataFrame, points: DataFrame, keys: list[str], metric: Callable[[Column], Column], none: Column | float, name: str = "distance") -> DataFrame:
    """Distance of each cell to the nearest point of the same key. ``metric`` speaks of cell columns and of the
    points' ``py, px``. The points of a key are gathered as a set first (at most one per grid cell, so of bounded
    size), so that each cell meets them within its row: no row is multiplied and only keys are joined."""
    near = points.groupBy(*keys).agg(F.collect_set(F.struct("py", "px")).alias("_p"))
    joined = cells.join(near, keys, "left")
    best = F.array_min(F.transform("_p", metric))
    return joined.withColumn(name, F.coalesce(best, none if isinstance(none, Column) else F.lit(float(none)))).drop("_p")


def euclidean(ty: str = "ty", tx: str = "tx"):
    return lambda p: F.hypot((F.col(ty) - p["py"]).cast("double"), (F.col(tx) - p["px"]).cast("double"))


def manhattan(y_ratio: float, x_ratio: float, ty: str = "ty", tx: str = "tx"):
    return lambda p: F.abs(F.col(ty) - p["py"]) * F.lit(float(y_ratio)) + F.abs(F.col(tx) - p["px"]) * F.lit(float(x_ratio))


def halo_density(cells: DataFrame, distance: str, base: float = 3.0, halo: float = 1.0, name: str = "pdn") -> DataFrame:
    """0 within a macro, half the base within its halo (by rows and columns), else the base; null: no macro."""
    d = F.col(distance)
    return cells.withColumn(name, F.when(d == 0, 0.0).when(d <= halo, 0.5 * base).otherwise(F.lit(float(base))))


def chebyshev(ty: str = "ty", tx: str = "tx"):
    return lambda p: F.greatest(F.abs(F.col(ty) - p["py"]), F.abs(F.col(tx) - p["px"])).cast("double")


def ring(inner: DataFrame, keys: list[str], radius: int, n: int, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Cells within ``radius`` of the given cells but not of them."""
    step = F.sequence(F.lit(-radius), F.lit(radius))
    around = inner.withColumn("_dy", F.explode(step)).withColumn("_dx", F.explode(step))
    moved = around.select(*keys, (F.col(ty) + F.col("_dy")).cast("int").alias(ty), (F.col(tx) + F.col("_dx")).cast("int").alias(tx)).where(f"{ty} between 0 and {n - 1} and {tx} between 0 and {n - 1}").distinct()
    return moved.join(inner.select(*keys, ty, tx), [*keys, ty, tx], "left_anti")


def fill_nearest(cells: DataFrame, filled: DataFrame, keys: list[str], value: str, ty: str = "ty", tx: str = "tx") -> DataFrame:
    """Each empty cell gets the value of the nearest filled one (ties: least ty, then tx). Filled cells of a key
    are gathered as a set, bounded by the grid."""
    near = filled.groupBy(*keys).agg(F.collect_set(F.struct(F.col(ty).alias("py"), F.col(tx).alias("px"), F.col(value).alias("v"))).alias("_p"))
    dist = euclidean(ty, tx)
    best = F.array_min(F.transform("_p", lambda p: F.struct(F.round(dist(p), 9).alias("d"), p["py"].alias("py"), p["px"].alias("px"), p["v"].alias("v"))))
    return cells.join(near, keys).withColumn(value, best["v"]).drop("_p")


def _nearest(rows: DataFrame, donors: DataFrame, keys: list[str], row_id: list[str], payload: list[str], bucket: float | None, strict: bool = False, per_bucket: float = 8.0, levels: int = 3) -> DataFrame:
    """keys, row_id and ``_b`` (d, then the payload): the nearest donor (``_dx, _dy``) of each row (``_x, _y``); ties by the
    payload; ``strict``: at a positive distance.

    Donors lie in square buckets, whose side follows from the density of the key's donors (``per_bucket`` a bucket on
    average) unless ``bucket`` gives it. A row looks into its own and the eight around, which is exact whenever what it
    finds is no further than a side; rows for which it is go on to buckets of eight times the side, and so on. What is
    left after all levels meets all donors of its key. What each level finds is written, so that no level is done twice."""
    held = stage(donors.select(*keys, "_dx", "_dy", *payload), "donors")
    if bucket is None:
        span = held.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max("_dx") - F.min("_dx")).alias("_w"), (F.max("_dy") - F.min("_dy")).alias("_h"))
        area = F.greatest(F.col("_w"), F.lit(1e-9)) * F.greatest(F.col("_h"), F.lit(1e-9))
        long = F.greatest("_w", "_h", F.lit(1e-9))
        side = span.select(*keys, F.greatest(F.sqrt(area / F.col("_n") * per_bucket), long / F.sqrt(F.col("_n")) / 1e3).alias("_side"))
    else:
        side = held.select(*keys).distinct().withColumn("_side", F.lit(float(bucket)))
    own = list(dict.fromkeys([*keys, *row_id, "_x", "_y"]))
    held, left = held.join(side, keys), rows.select(*own).join(side, keys)  # one row a key
    distance = F.hypot(F.col("_x") - F.col("_dx"), F.col("_y") - F.col("_dy"))
    best = F.min(F.when(distance > 0 if strict else distance.isNotNull(), F.struct(distance.alias("d"), *payload))).alias("_b")
    step, out = F.sequence(F.lit(-1).cast("bigint"), F.lit(1).cast("bigint")), None
    for level in range(levels):
        size = F.col("_side") * float(8**level)
        at = lambda c, size=size: F.floor(F.col(c) / size).cast("bigint")
        d = held.select(*keys, "_dx", "_dy", *payload, at("_dx").alias("_bx"), at("_dy").alias("_by"))
        looks = left.withColumn("_by", at("_y")).withColumn("_bx", at("_x"))
        for c in ("_by", "_bx"):
            looks = looks.withColumn(c, F.explode(F.transform(step, lambda s: s + F.col(c))))  # noqa: B023
        met = stage(looks.join(d, [*keys, "_bx", "_by"], "left").groupBy(*own, "_side").agg(best), "near")
        found = F.coalesce(F.col("_b.d") <= size, F.lit(False))
        settled = met.where(found).select(*keys, *row_id, "_b")
        out = settled if out is None else out.unionByName(settled)
        left = met.where(~found).select(*own, "_side")
        if not left.limit(1).count():
            return out
    return out.unionByName(left.join(held.drop("_side"), keys).groupBy(*keys, *row_id).agg(best).where("_b is not null"))


def nearest_row(rows: DataFrame, donors: DataFrame, keys: list[str], bucket: float | None, value: str, row_id: str, donor_id: str, x: str = "x_um", y: str = "y_um") -> DataFrame:
    """For each row the value of the nearest donor of its key (ties: least donor id), by buckets of the given side or, if
    it is None, of one that follows the donors' density."""
    d = donors.select(*keys, F.col(donor_id).alias("_id"), F.col(x).alias("_dx"), F.col(y).alias("_dy"), F.col(value).alias("_v"))
    r = rows.select(*keys, row_id, F.col(x).alias("_x"), F.col(y).alias("_y"))
    found = _nearest(r, d, keys, [row_id], ["_id", "_v"], bucket)
    return found.select(*keys, row_id, F.col("_b._v").alias(value), F.col("_b._id").alias("donor"), F.col("_b.d").alias("distance"))


def pitch(points: DataFrame, keys: list[str], point_id: str, x: str = "x_um", y: str = "y_um") -> DataFrame:
    """Median over points of the distance to the nearest other point at a positive distance. Points of one place are
    looked up once and count as many."""
    places = stage(points.where(F.col(point_id).isNotNull()).groupBy(*keys, F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count("*").alias("_times")), "places")
    found = _nearest(places, places.withColumnsRenamed({"_x": "_dx", "_y": "_dy"}), keys, ["_x", "_y"], [], None, strict=True)
    near = places.join(found.select(*keys, "_x", "_y", F.col("_b.d").alias("d")), [*keys, "_x", "_y"], "left")
    return near.groupBy(*keys).agg(F.percentile("d", 0.5, F.col("_times")).alias("pitch"))


def mesh_edges(grids: DataFrame, keys: list[str], strap: str, sheet: Column | float, n: int) -> DataFrame:
    """Right and downward edges of n by n grids (arrays, see :func:`gridloom.operators.raster.gathered`) with conductance
    ``sheet * mean of both strap densities``. Each grid is exploded where it is; nothing is joined."""
    s = sheet if isinstance(sheet, Column) else F.lit(float(sheet))
    cells = grids.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    at = [("right", F.lit(1), F.col("_p") % n < n - 1), ("down", F.lit(n), F.col("_p") < n * (n - 1))]
    ends = F.array(*(F.when(inside, F.struct(F.lit(name).alias("direction"), (F.col("_p") + step).alias("o"))) for name, step, inside in at))
    edges = cells.withColumn("_e", F.explode(ends)).where("_e is not null")
    g = s * 0.5 * (F.col(strap)[F.col("_p")] + F.get(F.col(strap), F.col("_e.o")))
    return edges.select(*keys, F.expr(f"cast(_p div {n} as int)").alias("ty"), (F.col("_p") % n).cast("int").alias("tx"), F.col("_e.direction").alias("direction"), g.alias("g"))


def ramp(ty: Column, tx: Column, n: int) -> Column:
    """Deterministic ramp from the centre of the grid; 1 in its first corner, where it is greatest."""
    return F.abs(ty - n / 2) / n + F.abs(tx - n / 2) / n
