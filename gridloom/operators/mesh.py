"""The supply mesh of each design: solves A u = i for all its scenarios at once.

A is the Laplacian of the grid's edges plus the conductance of supply bumps on its diagonal. The grid has a
fixed size, so that a group (the cells of one design and its right-hand sides) is bounded whatever the corpus;
designs are independent and spread over the cluster. The kernel is a block tridiagonal factorisation: one block
per grid row, off-diagonal blocks are diagonal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numeric import ratio


class Mesh:
    """A factorised n by n mesh. ``right``: conductance to the right neighbour (n, n-1); ``down``: to the lower
    one (n-1, n); ``supply``: conductance to the supply (n, n). Raises without any supply."""

    def __init__(self, right: np.ndarray, down: np.ndarray, supply: np.ndarray) -> None:
        if not (supply > 0).any():
            raise ValueError("a mesh without supply cannot be solved")
        self.n, self.m = supply.shape
        self.right, self.down, self.supply = right, down, supply
        diagonal = supply.astype(float).copy()
        diagonal[:, :-1] += right
        diagonal[:, 1:] += right
        diagonal[:-1] += down
        diagonal[1:] += down
        self.inverse: list[np.ndarray] = []
        for i in range(self.n):
            block = np.diag(diagonal[i]) - np.diag(right[i], 1) - np.diag(right[i], -1)
            if i:
                block = block - down[i - 1][:, None] * self.inverse[-1] * down[i - 1][None, :]
            self.inverse.append(np.linalg.inv(block))

    @classmethod
    def of_straps(cls, straps: np.ndarray, sheet: float, supply: np.ndarray) -> Mesh:
        """Edges conduct the sheet conductance times the mean density of their ends."""
        return cls(sheet * 0.5 * (straps[:, :-1] + straps[:, 1:]), sheet * 0.5 * (straps[:-1] + straps[1:]), supply)

    def solve(self, current: np.ndarray) -> np.ndarray:
        """Drops for currents of shape (n, m), (n * m) or (n, m, scenarios)."""
        given = np.asarray(current, float)
        if given.size % (self.n * self.m):
            raise ValueError("currents must have the size of the mesh")
        rhs = given.reshape(self.n, self.m, -1)
        forward = []
        for i in range(self.n):
            forward.append(rhs[i] if not i else rhs[i] + self.down[i - 1][:, None] * (self.inverse[i - 1] @ forward[-1]))
        out = np.empty_like(rhs)
        for i in range(self.n - 1, -1, -1):
            more = forward[i] if i == self.n - 1 else forward[i] + self.down[i][:, None] * out[i + 1]
            out[i] = self.inverse[i] @ more
        return out.reshape(given.shape)

    def residual(self, drop: np.ndarray, current: np.ndarray) -> float:
        """Greatest error of A u = i."""
        u = drop
        flow = self.supply * u
        h, v = self.right * (u[:, :-1] - u[:, 1:]), self.down * (u[:-1] - u[1:])
        flow[:, :-1] += h
        flow[:, 1:] -= h
        flow[:-1] += v
        flow[1:] -= v
        return float(np.abs(flow - current).max())

    def scaled_to(self, current: np.ndarray, target: float) -> float:
        """The factor by which both conductances must grow for the greatest drop to be ``target``."""
        return float(self.solve(current).max() / target)


def _system(a: pa.Table, b: pa.Table, n: int, weak: bool, strap: float) -> tuple[Mesh | None, list[str], np.ndarray]:
    """Mesh, scenarios and right-hand sides of one design; no mesh without supply or scenarios."""
    col = lambda t, c: t.column(c).to_numpy()
    straps, supply = np.full((n, n), strap), np.zeros((n, n))
    at = col(a, "ty"), col(a, "tx")
    straps[at], supply[at] = col(a, "strap"), col(a, "supply")
    scenarios = sorted({s for s in b.column("scenario").to_pylist() if s is not None})
    place = {s: i for i, s in enumerate(scenarios)}
    rhs = np.zeros((n, n, len(scenarios) + weak))
    if scenarios:
        np.add.at(rhs, (col(b, "ty"), col(b, "tx"), np.array([place[s] for s in b.column("scenario").to_pylist()])), col(b, "current_a"))
    if weak:
        rhs[:, :, -1] = 1.0 / (n * n)
        scenarios.append("__weak__")
    solvable = bool((supply > 0).any()) and bool(scenarios)
    return Mesh.of_straps(np.maximum(straps, 1e-9), float(col(a, "sheet")[0]), supply) if solvable else None, scenarios, rhs


def _by_design(cells: DataFrame, currents: DataFrame, keys: list[str], run: Callable[[tuple, pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` on the cells and currents of each key; its columns after the keys are ``schema``."""
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    driven = currents.select(*(F.col(k).alias(k) for k in keys), "scenario", "ty", "tx", F.col("current_a").cast("double").alias("current_a")).dropna(subset=["scenario", "current_a"])
    grid = cells.select(*keys, "ty", "tx", *(F.col(c).cast("double").alias(c) for c in ("strap", "sheet", "supply")))
    return grid.groupBy(*keys).cogroup(driven.groupBy(*keys)).applyInArrow(run, f"{kinds}, {schema}")


def _per_scenario(cells: DataFrame, currents: DataFrame, n: int, keys: list[str], strap: float, name: str, measure: Callable[[Mesh, np.ndarray], np.ndarray]) -> DataFrame:
    """keys, scenario and one number of each scenario, made where its mesh is solved: the n * n drops stay in their group."""

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        made, scenarios, rhs = _system(a, b, n, False, strap)
        scenarios = scenarios if made else []
        fixed = [pa.array([k.as_py()] * len(scenarios)).cast(k.type) for k in key]
        return pa.table([*fixed, pa.array(scenarios, pa.string()), pa.array(measure(made, rhs) if made else [], pa.float64())], names=[*keys, "scenario", name])

    return _by_design(cells, currents, keys, run, f"scenario string, {name} double")


def solved_residuals(cells: DataFrame, currents: DataFrame, n: int, keys: list[str] = ["design"], strap: float = 0.0) -> DataFrame:  # noqa: B006
    """Greatest error of A u = i per key and scenario, from the flows over the mesh's edges, which the factorisation does
    not use. As :func:`residuals` of the solution, without moving its n * n rows a scenario."""
    return _per_scenario(cells, currents, n, keys, strap, "residual", lambda m, i: np.array([m.residual(u, c) for u, c in zip(np.moveaxis(m.solve(i), 2, 0), np.moveaxis(i, 2, 0), strict=True)]))


def superposed_difference(cells: DataFrame, currents: DataFrame, n: int, keys: list[str] = ["design"], strap: float = 0.0) -> DataFrame:  # noqa: B006
    """Greatest difference, per key and scenario, of the direct solution and the superposition of the influences of all
    cells that carry current. As :func:`influence_solve` against :func:`solve_designs`; an influence table (n * n rows a
    source) is held for one design at a time."""

    def measure(m: Mesh, i: np.ndarray) -> np.ndarray:
        flat = i.reshape(n * n, -1)
        at = np.flatnonzero((flat != 0).any(axis=1))
        unit = np.zeros((n * n, len(at)))
        unit[at, np.arange(len(at))] = 1.0
        other = m.solve(unit.reshape(n, n, -1)).reshape(n * n, -1) @ flat[at] if len(at) else np.zeros_like(flat)
        return np.abs(m.solve(i).reshape(n * n, -1) - other).max(axis=0)

    return _per_scenario(cells, currents, n, keys, strap, "difference", measure)


def solve_designs(cells: DataFrame, currents: DataFrame, n: int, keys: list[str] = ["design"], weak: bool = False, strap: float = 0.0) -> DataFrame:  # noqa: B006
    """``cells``: keys, ty, tx, strap, sheet, supply (absent cells: ``strap``, no supply). ``currents``: keys,
    scenario, ty, tx, current_a. Result: keys, scenario, ty, tx, drop_v. With ``weak`` a scenario ``__weak__``
    spreads one ampere evenly. Designs without any supply have no rows."""
    names = [*keys, "scenario", "ty", "tx", "drop_v"]

    def run(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        made, scenarios, rhs = _system(a, b, n, weak, strap)
        u = made.solve(rhs) if made else np.zeros((0, 0, 0))
        ty, tx, s = (x.ravel().astype(np.int32) for x in np.meshgrid(*(np.arange(k) for k in u.shape), indexing="ij"))
        fixed = [pa.array([k.as_py()] * len(s)).cast(k.type) for k in key]
        return pa.table([*fixed, pa.array([scenarios[i] for i in s], pa.string()), pa.array(ty), pa.array(tx), pa.array(u.ravel())], names=names)

    return _by_design(cells, currents, keys, run, "scenario string, ty int, tx int, drop_v double")


def influence(cells: DataFrame, n: int, keys: list[str] = ["design"], sources: DataFrame | None = None) -> DataFrame:  # noqa: B006
    """Drop at every cell for one ampere at every other: keys, sty, stx (source), ty, tx, volt_per_amp. Only for
    what-if questions on chosen designs (n ** 4 rows each). With ``sources`` (keys, ty, tx) only their cells are
    sources; cells without current add nothing to a superposition."""
    every = cells.select(*keys).distinct()
    if sources is None:
        sources = every.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))))
    else:
        sources = sources.select(*keys, (F.col("ty") * n + F.col("tx")).alias("_c")).distinct().join(every, keys, "left_semi")
    unit = sources.select(*keys, F.col("_c").cast("string").alias("scenario"), F.expr(f"cast(_c div {n} as int)").alias("ty"), (F.col("_c") % n).cast("int").alias("tx"), F.lit(1.0).alias("current_a"))
    table = solve_designs(cells, unit, n, keys)
    return table.select(*keys, F.expr(f"cast(cast(scenario as int) div {n} as int)").alias("sty"), (F.col("scenario").cast("int") % n).alias("stx"), "ty", "tx", F.col("drop_v").alias("volt_per_amp"))


def influence_solve(table: DataFrame, currents: DataFrame, keys: list[str] = ["design"]) -> DataFrame:  # noqa: B006
    """Drops by superposition: the current of each source times its influence, summed."""
    at = currents.withColumnsRenamed({"ty": "sty", "tx": "stx"})
    return table.join(at, [*keys, "sty", "stx"]).groupBy(*keys, "scenario", "ty", "tx").agg(F.sum(F.col("volt_per_amp") * F.col("current_a")).alias("drop_v"))


def residuals(solved: DataFrame, cells: DataFrame, currents: DataFrame, edges: DataFrame, keys: list[str] = ["design"]) -> DataFrame:  # noqa: B006
    """Greatest error of A u = i per key and scenario, by joins alone (an independent check of the kernel). Each cell has
    its conductances to its neighbours first, so that the drops are joined once: to the cells around them."""
    down, right = (F.col("direction") == "down").cast("int"), (F.col("direction") == "right").cast("int")
    near = F.struct("ty", "tx"), F.struct((F.col("ty") + down).alias("ty"), (F.col("tx") + right).alias("tx"))
    one = lambda a, b, g: F.struct(a["ty"].alias("ty"), a["tx"].alias("tx"), b["ty"].alias("oy"), b["tx"].alias("ox"), g.alias("g"))
    g = F.col("g")
    # row (ty, tx) of A: what the drop at (oy, ox) adds to it
    ends = F.array(one(near[0], near[0], g), one(near[1], near[1], g), one(near[0], near[1], -g), one(near[1], near[0], -g))
    entries = edges.select(*keys, F.explode(ends).alias("e")).select(*keys, "e.*")
    own = cells.where("supply > 0").select(*keys, "ty", "tx", F.col("ty").alias("oy"), F.col("tx").alias("ox"), F.col("supply").alias("g"))
    entries = entries.unionByName(own).groupBy(*keys, "ty", "tx", "oy", "ox").agg(F.sum("g").alias("g"))
    u = solved.select(*keys, "scenario", F.col("ty").alias("oy"), F.col("tx").alias("ox"), "drop_v")
    made = u.join(entries, [*keys, "oy", "ox"]).select(*keys, "scenario", "ty", "tx", (F.col("g") * F.col("drop_v")).alias("f"))
    solvable = cells.where("supply > 0").select(*keys).distinct()
    given = currents.join(solvable, keys, "left_semi").select(*keys, "scenario", "ty", "tx", (-F.col("current_a")).alias("f"))
    total = made.unionByName(given.select(made.columns)).groupBy(*keys, "scenario", "ty", "tx").agg(F.sum("f").alias("r"))
    return total.groupBy(*keys, "scenario").agg(F.max(F.abs("r")).alias("residual"))


def conductances(k_sheet: Column | float, k_bump: Column | float, strap_width: Column, strap_pitch: Column) -> tuple[Column, Column]:
    """Sheet and bump conductance of a design from its strap geometry; null without a pitch."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    fill = ratio(strap_width, strap_pitch)
    return lit(k_sheet) * fill, lit(k_bump) * fill


def calibration(drop: str, target: float) -> Column:
    """Scale of the conductances for which the greatest drop of a group becomes ``target``."""
    return F.max(drop) / F.lit(target)
