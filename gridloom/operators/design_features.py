"""The 32 features of all tiles of one design, in arrays, where its rows meet.

Nothing of a design grows with its rows: instances and bumps are tallied batch by batch into grids and into counts of
(module, cell), and what is made of them goes on in blocks of scenarios. A feature table by joins would write each of
the n * n tiles of every scenario again for each join; here they are written by whoever reads the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from gridloom.operators.mesh import Mesh
from gridloom.operators.spatial import blur_matrix, grid_distances
from gridloom.sources.schema import FEATURES, IDENTITY

#: The kinds of rows: see :func:`gridloom.operators.features.design_rows`.
PARAMS, INSTANCE, MACRO, BUMP, STRAP, MODULE, ACTIVITY = range(7)
#: Scenarios made at once, and sub-cells of a tile's side for the share under macros.
BLOCK, SUB, TOP = 32, 16, 4
TILE = ["grid_weak", "grid_strap_mean", "grid_strap_min", "grid_bumps", "grid_dbump_min", "grid_dbump_max", "top_macro_frac", "top_dmacro", "top_edge_dist", "top_util", "top_cells", "top_capden", "top_clkden", "top_seqden"]


def _over(num: np.ndarray, den: np.ndarray, otherwise: float) -> np.ndarray:
    """num / den where den > 0, else ``otherwise``."""
    return np.divide(num, den, out=np.full(np.broadcast(num, den).shape, otherwise), where=den > 0)


def _starts(of: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)


def _filled(v: np.ndarray) -> np.ndarray:
    """Nulls, which Arrow gives as NaN, add nothing."""
    return np.where(np.isnan(v), 0.0, v)


@lru_cache
def _blurs(n: int) -> dict[float, np.ndarray]:
    return {s: blur_matrix(s, n) for s in (1.0, 2.0, 4.0)}


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """As :func:`gridloom.plans.base.rounded`, which takes longer than all the rest. Beyond 2 ** 33 a number of six digits has no more."""
    if digits is None:
        return v
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(np.abs(v) < 2**33, np.rint((v + 0.033 * 10**-digits) * 10.0**digits) / 10.0**digits + 0.0, v)


def average_ranks(values: np.ndarray) -> np.ndarray:
    """Rank from 1 within each row, ties sharing their average, over the row's length."""
    out = np.empty(values.shape)
    for row, x in zip(out, values, strict=True):
        _, at, n = np.unique(x, return_inverse=True, return_counts=True)
        row[:] = (np.cumsum(n) - (n - 1) / 2)[at] / len(x)
    return out


class Design:
    """What the rows of one design add up to. ``fixed``: die_w_um, die_h_um, vdd_v, sheet, bump, unless a row has them."""

    def __init__(self, fine: int, coarse: int, fixed: list[float] | None) -> None:
        self.fine, self.n, self.r, self.params = fine, coarse, fine // coarse, fixed
        self.modules: dict[str | None, int] = {}
        self.scenarios: dict[str, int] = {}
        self.domains: dict[str | None, str | None] = {}
        self.rated: dict[str | None, float] = {}
        self.cells = np.zeros(0, np.int64), np.zeros(0)  # (module, fine cell) in one number; how many instances
        self.tiles = np.zeros(0, np.int64), np.zeros(0)  # likewise by coarse tile
        self.sums = np.zeros((5, coarse * coarse))  # instances, area, capacitance, clock cells, sequential cells
        self.bumps, self.points = np.zeros(coarse * coarse), np.zeros(fine * fine, bool)
        self.straps = np.zeros(fine * fine)
        self.macros: list[tuple[int, np.ndarray]] = []
        self.activity: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.seen: set[int] = set()

    def _numbers(self, names: pa.Array, of: dict) -> np.ndarray:
        return np.array([of.setdefault(x, len(of)) for x in names.to_pylist()], np.int64)

    def add(self, batch: pa.RecordBatch) -> None:
        kinds = batch.column("k").to_numpy()
        for k in np.unique(kinds):
            part = batch.filter(pa.array(kinds == k))
            v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            self.seen.add(int(k))
            (self._params, self._instances, self._macros, self._bumps, self._straps, self._modules, self._activity)[k](part.column("s"), part.column("t"), v)

    def _params(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        self.params = list(v[-1])

    def _instances(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        m, tile, cell = self._numbers(s, self.modules), v[:, 0].astype(np.int64), v[:, 1].astype(np.int64)
        self.sums += [np.bincount(tile, w, self.n * self.n) for w in (np.ones(len(v)), *_filled(v[:, 2:]).T)]
        for name, at in (("tiles", m * self.n**2 + tile), ("cells", m * self.fine**2 + cell)):
            held, count = getattr(self, name)
            keys, back = np.unique(np.concatenate([held, at]), return_inverse=True)
            setattr(self, name, (keys, np.bincount(back, np.concatenate([count, np.ones(len(at))]))))

    def _macros(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        self.macros += zip(self._numbers(s, self.modules).tolist(), v, strict=True)

    def _bumps(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        self.bumps += np.bincount(v[:, 0].astype(np.int64), minlength=self.n * self.n)
        self.points[v[:, 1].astype(np.int64)] = True

    def _straps(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        v = v[~np.isnan(v[:, 0])]  # the others lie beyond the grid
        self.straps[v[:, 0].astype(np.int64)] = _filled(v[:, 1])

    def _modules(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        for module, domain, rated in zip(s.to_pylist(), t.to_pylist(), v[:, 0].tolist(), strict=True):
            self.domains[module], self.rated[module] = domain, rated

    def _activity(self, s: pa.Array, t: pa.Array, v: np.ndarray) -> None:
        self.activity.append((self._numbers(s, self.scenarios), self._numbers(t, self.modules), v))

    def _by_tile(self) -> dict[str, np.ndarray]:
        """The features that all scenarios share, but the mesh's."""
        n, r, fine = self.n, self.r, self.fine
        blocks = lambda g: g.reshape(n, r, n, r)
        none = float((2 * fine * fine) ** 0.5)
        away = lambda held: blocks(grid_distances(held)) if held.any() else blocks(np.full((fine, fine), none))
        held, under = np.zeros((fine, fine), bool), np.zeros((n * SUB, n * SUB), bool)
        for _, v in self.macros:
            a, b, c, d = v[:4].astype(int)
            held[a : b + 1, c : d + 1] = True
            a, b, c, d = v[8:12].astype(int)
            under[a:b, c:d] = True
        to_bump, to_macro, straps = away(self.points.reshape(fine, fine)), away(held), blocks(self.straps.reshape(fine, fine))
        cells, area, cap, clk, seq = self.sums
        side = np.minimum(np.arange(n), n - 1 - np.arange(n))
        tile_area = self.params[0] * self.params[1] / (n * n)
        out = {"grid_strap_mean": straps.sum(axis=(1, 3)) / (r * r), "grid_strap_min": straps.min(axis=(1, 3)), "grid_bumps": self.bumps, "grid_dbump_min": to_bump.min(axis=(1, 3)), "grid_dbump_max": to_bump.max(axis=(1, 3))}
        out |= {"top_macro_frac": under.view(np.uint8).reshape(n * SUB, n, SUB).sum(axis=2, dtype=np.int32).reshape(n, SUB, n).sum(axis=1) / float(SUB * SUB), "top_dmacro": to_macro.min(axis=(1, 3)), "top_edge_dist": np.minimum(side[:, None], side[None, :]).astype(float)}
        out |= {"top_util": area / tile_area, "top_cells": cells, "top_capden": cap / tile_area, "top_clkden": _over(clk, cells, 0.0), "top_seqden": _over(seq, cells, 0.0)}
        return {k: v.ravel() for k, v in out.items()}

    def _units(self, n: int, counted: tuple[np.ndarray, np.ndarray], first: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, modules and currents at activity 1 on an n by n grid: instances share their module's, macros theirs. A cell
        may come several times for a module."""
        vdd, names = self.params[2], list(self.modules)
        all_of = np.bincount(self.tiles[0] // self.n**2, self.tiles[1], len(names))
        rated = _filled(np.array([self.rated.get(x, 0.0) for x in names], float)) * 1e-3
        m = counted[0] // (n * n)
        parts = [(counted[0] % (n * n), m, counted[1] * (rated[m] / all_of[m]) / vdd)]
        for module, v in self.macros:
            a, b, c, d = v[first : first + 4].astype(int)
            at = (np.arange(a, b + 1)[:, None] * n + np.arange(c, d + 1)[None, :]).ravel()
            power = 0.0 if np.isnan(v[12]) else v[12]
            parts.append((at, np.full(len(at), module), np.full(len(at), power * 1e-3 / vdd / len(at))))
        cell, m, unit = (np.concatenate(x) for x in zip(*parts, strict=True))
        used = known[m]
        return cell[used], m[used], unit[used]

    def _scenarios(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scenarios in order; activity by module and scenario with whether there is any; power fraction; weight."""
        names = sorted(x for x in self.scenarios if x is not None)
        place = {x: i for i, x in enumerate(names)}
        to = np.array([place.get(x, -1) for x in self.scenarios])
        s, m, v = (np.concatenate(x) for x in zip(*self.activity, strict=True))
        named = to[s] >= 0
        s, m, v = to[s][named], m[named], v[named]
        weight = np.full(len(names), np.nan)
        np.fmin.at(weight, s, v[:, 1])
        listed = np.array([x is not None for x in self.modules])[m]
        s, m, a = s[listed], m[listed], v[listed, 0]
        rated = np.array([self.rated.get(x, np.nan) for x in self.modules], float)[m]
        some, total = (np.bincount(s, _filled(x), len(names)) for x in (rated * a, rated))
        there = ~np.isnan(a)
        active, has = np.zeros((len(self.modules), len(names))), np.zeros((len(self.modules), len(names)), bool)
        np.add.at(active, (m[there], s[there]), a[there])
        has[m[there], s[there]] = True
        return names, active, has, _over(some, total, 0.0), weight

    def features(self, design: str, digits: int | None = None) -> Iterator[pa.RecordBatch]:
        """IDENTITY and FEATURES, a batch for each block of scenarios; none without bumps or scenarios."""
        if self.params is None or ACTIVITY not in self.seen:
            return
        n, r, fine = self.n, self.r, self.fine
        sheet, bump = self.params[3:]
        supply = (self.bumps * bump).reshape(n, n)
        names, active, has, fraction, weight = self._scenarios()
        if not (supply > 0).any() or not names:
            return
        tiles = self._by_tile()
        mesh = Mesh.of_straps(np.maximum(tiles["grid_strap_mean"].reshape(n, n), 1e-9), sheet, supply)
        tiles["grid_weak"] = mesh.solve(np.full((n, n), 1.0 / (n * n))).ravel()
        weak = tiles["grid_weak"]

        known = np.array([x is not None for x in self.modules])
        kinds: dict[str | None, int] = {}
        domain = np.array([kinds.setdefault(self.domains.get(x), len(kinds)) for x in self.modules], np.int64)
        cell, module, unit = self._units(n, self.tiles, 4, known)
        order = np.argsort(cell * len(kinds) + domain[module], kind="stable")
        cell, module, unit = cell[order], module[order], unit[order]
        by_domain = _starts(cell * len(kinds) + domain[module])
        by_tile = _starts(cell[by_domain])
        where = cell[by_domain][by_tile]
        f_cell, f_module, f_unit = self._units(fine, self.cells, 0, known)
        order = np.argsort(f_cell, kind="stable")
        f_cell, f_module, f_unit = f_cell[order], f_module[order], f_unit[order]
        by_cell = _starts(f_cell)
        fy, fx = np.divmod(f_cell[by_cell], fine)
        f_tile, place = np.unique(fy // r * n + fx // r, return_inverse=True)
        within = fy % r * r + fx % r

        blur = _blurs(n)
        blurred = lambda g, s: (blur[s] @ g.reshape(-1, n, n) @ blur[s].T).reshape(len(g), -1)
        for i in range(0, len(names), BLOCK):
            part = slice(i, i + BLOCK)
            size = len(names[part])
            tall = lambda a, at, otherwise=0.0: _spread(a, at, n * n, otherwise)
            # currents and shares of the clock domains
            c = np.add.reduceat(unit[:, None] * active[module, part], by_domain) if len(unit) else np.zeros((0, size))
            t, q, m = (f.reduceat(x, by_tile) if len(c) else c for f, x in ((np.add, c), (np.add, c * c), (np.maximum, c)))
            out = {"cur_sum": tall(t, where), "sw_hhi": tall(_over(q, t * t, 0.0), where), "sw_topshare": tall(_over(m, t, 0.0), where)}
            # fine cells within their tiles; absent ones are 0, and only where a current is negative does it matter that they are absent
            x = f_unit[:, None] * active[f_module, part]
            grid = np.zeros((len(f_tile), r * r, size))
            if len(x):
                grid[place, within] = np.add.reduceat(x, by_cell)
            s, best = grid.sum(axis=1), grid
            if (x < 0).any():
                there = np.zeros(grid.shape, bool)
                there[place, within] = np.logical_or.reduceat(has[f_module, part], by_cell)
                best = np.where(there, grid, -np.inf)
            best = np.sort(best, axis=1)[:, ::-1]
            m, best = (np.where(np.isinf(b), 0.0, b) for b in (best[:, :1], best[:, :TOP]))
            m, best = m.sum(axis=1), best.sum(axis=1)
            out |= {"cur_max_fine": tall(m, f_tile), "conc_ratio": tall(_over(m, s / (r * r), 1.0), f_tile, 1.0), "conc_top4": tall(_over(best, s, TOP / (r * r)), f_tile, TOP / (r * r))}
            # the solved mesh
            u = mesh.solve(out["cur_sum"].T.reshape(n, n, size)).reshape(n * n, size).T
            out |= {"phys_base_v": u, "phys_base_s1": blurred(u, 1.0), "phys_base_s2": blurred(u, 2.0), "phys_base_rank": average_ranks(u)}
            out |= {f"cur_s{s:.0f}": blurred(out["cur_sum"], s) for s in blur}
            out |= {"cur_x_weak": out["cur_sum"] * weak, "cur_s2_x_weak": out["cur_s2"] * weak, "conc_x_weak": out["conc_ratio"] * weak}
            columns = {k: pa.array(rounded(v.ravel(), digits)) for k, v in out.items()} | {k: pa.array(np.tile(rounded(tiles[k], digits), size)) for k in TILE}
            columns |= {"scn_power_frac": pa.array(np.repeat(rounded(fraction[part], digits), n * n)), "scn_weight": pa.array(np.repeat(rounded(weight[part], digits), n * n), from_pandas=True)}
            ty, tx = np.divmod(np.tile(np.arange(n * n, dtype=np.int32), size), np.int32(n))
            columns |= {"design": pa.repeat(design, n * n * size), "scenario": pa.array(names[part], pa.string()).take(pa.array(np.repeat(np.arange(size), n * n))), "ty": pa.array(ty), "tx": pa.array(tx)}
            yield pa.RecordBatch.from_arrays([columns[k] for k in (*IDENTITY, *FEATURES)], names=[*IDENTITY, *FEATURES])


def _spread(values: np.ndarray, at: np.ndarray, size: int, otherwise: float) -> np.ndarray:
    """Values (place, scenario) as (scenario, all places)."""
    out = np.full((values.shape[1], size), otherwise)
    out[:, at] = values.T
    return out
