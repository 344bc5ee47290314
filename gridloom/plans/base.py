"""Clean views of the domain tables, in Spark and as SQL, and the register of queries.

Views: ``m`` modules, ``a`` activity, ``i`` instances, ``c`` macros, ``f`` features, ``r`` drop maps (``rt`` by tile), ``p`` coverage
per design, ``b`` bumps and ``s`` planned straps (both from the raw records). Names are trimmed and in lower case, one
row per key (repeats and versions reduced by their greatest valid value), NaN is null. The die is a fixed square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.names import clean_name
from gridloom.functions.numeric import finite
from gridloom.operators.record_errors import loaded_records
from gridloom.session import table
from gridloom.sources.schema import BUDGET_V, FEATURES, VDD_V

DIE, N, FINE_N = 760.0, 24, 96


class Views:
    """The views of one data directory; each is made when it is asked for."""

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    def _clean(self, name: str, design: str, names: list[str]) -> DataFrame:
        df = table(self.spark, self.sf, name)
        df = df.withColumn("design", clean_name(design)).where("design is not null")
        for n in names:
            df = df.withColumn(n, clean_name(n))
        return df.dropna(subset=names)

    @property
    def m(self) -> DataFrame:
        return self._clean("modules", "design_id", ["module"]).where("deleted_at is null").groupBy("design", "module").agg(*(F.max(c).alias(c) for c in ("clock_domain", "power_domain")), F.max(finite("rated_power_mw")).alias("rated_power_mw"))

    @property
    def a(self) -> DataFrame:
        ok = lambda c: F.max(F.when(F.col(c).between(0, 1), F.col(c))).alias(c)
        return self._clean("activity", "design_id", ["scenario", "module"]).groupBy("design", "scenario", "module").agg(ok("activity"), ok("mission_weight"))

    @property
    def i(self) -> DataFrame:
        df = self._clean("instances", "design_id", []).where("deleted_at is null and inst_id is not null and x_um is not null and y_um is not null and not isnan(x_um) and not isnan(y_um)")
        return df.groupBy("design", "inst_id").agg(F.max(clean_name("module")).alias("module"), *(F.max(finite(c)).alias(c) for c in ("x_um", "y_um", "area_um2", "cap_ff")), *(F.max(c).alias(c) for c in ("is_seq", "is_clk", "is_macro")))

    @property
    def c(self) -> DataFrame:
        df = self._clean("macros", "design_id", []).dropna(subset=["x0_um", "y0_um", "x1_um", "y1_um"])
        return df.groupBy("design", "macro_id").agg(F.max(clean_name("module")).alias("module"), *(F.max(finite(c)).alias(c) for c in ("x0_um", "y0_um", "x1_um", "y1_um", "power_mw")))

    @property
    def f(self) -> DataFrame:
        df = self._clean("features", "design", ["scenario"])
        return df.groupBy("design", "scenario", "ty", "tx").agg(*(F.max(finite(c)).alias(c) for c in (*FEATURES, "label_v")))

    @property
    def r(self) -> DataFrame:
        return self._clean("irmap", "design_id", ["scenario"]).where("drop_v between 0 and 0.2").groupBy("design", "scenario", "fy", "fx").agg(F.max("drop_v").alias("drop_v"))

    @property
    def rt(self) -> DataFrame:
        """``r`` with ``ty, tx`` of its coarse tile, shuffled once: by tile, which serves the cells and the tiles."""
        rows = self._clean("irmap", "design_id", ["scenario"]).where("drop_v between 0 and 0.2")
        tile = ["design", "scenario", "ty", "tx"]
        rows = rows.select("design", "scenario", F.expr("cast(fy div 4 as int)").alias("ty"), F.expr("cast(fx div 4 as int)").alias("tx"), "fy", "fx", "drop_v")
        return rows.repartition(*tile).groupBy(*tile, "fy", "fx").agg(F.max("drop_v").alias("drop_v"))

    @property
    def p(self) -> DataFrame:
        return self._clean("picp_per_design", "design", []).dropna(subset=["variant", "seed", "fold"]).groupBy("variant", "seed", "fold", "design").agg(F.max(finite("picp")).alias("picp"), F.max(finite("mpiw_mv")).alias("mpiw_mv"))

    def _records(self, file: str) -> DataFrame:
        raw = table(self.spark, self.sf, "raw_lines").where(F.col("file_name") == file).select(clean_name("design_id").alias("design"), "line_id", "raw_line", F.col("file_name").alias("_file"))
        return loaded_records(raw, ["design", "line_id"], "raw_line", "_file")

    @property
    def b(self) -> DataFrame:
        return self._records("bumps").groupBy("design", "bump_id").agg(F.max("x_um").alias("x_um"), F.max("y_um").alias("y_um"))

    @property
    def s(self) -> DataFrame:
        return self._records("strap_planned").groupBy("design", "fy", "fx").agg(F.max("density").alias("density"))


_NAME = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_D, _S, _M = _NAME.format("design_id"), _NAME.format("scenario"), _NAME.format("module")
_num = lambda c: f"max(CASE WHEN cast({c} AS varchar) <> 'nan' THEN {c} END) AS {c}"
_unit = lambda c: f"max(CASE WHEN {c} BETWEEN 0 AND 1 THEN {c} END) AS {c}"

BASE = f"""
m AS (SELECT {_D} AS design, {_M} AS module, max(clock_domain) AS clock_domain, max(power_domain) AS power_domain, {_num("rated_power_mw")} FROM modules WHERE module IS NOT NULL AND design_id IS NOT NULL AND deleted_at IS NULL GROUP BY 1, 2),
a AS (SELECT {_D} AS design, {_S} AS scenario, {_M} AS module, {_unit("activity")}, {_unit("mission_weight")} FROM activity WHERE design_id IS NOT NULL AND scenario IS NOT NULL AND module IS NOT NULL GROUP BY 1, 2, 3),
i AS (SELECT {_D} AS design, inst_id, max({_M}) AS module, {_num("x_um")}, {_num("y_um")}, {_num("area_um2")}, {_num("cap_ff")}, max(is_seq) AS is_seq, max(is_clk) AS is_clk, max(is_macro) AS is_macro
  FROM instances WHERE deleted_at IS NULL AND inst_id IS NOT NULL AND x_um IS NOT NULL AND y_um IS NOT NULL AND cast(x_um AS varchar) <> 'nan' AND cast(y_um AS varchar) <> 'nan' GROUP BY 1, 2),
c AS (SELECT {_D} AS design, macro_id, max({_M}) AS module, {_num("x0_um")}, {_num("y0_um")}, {_num("x1_um")}, {_num("y1_um")}, {_num("power_mw")} FROM macros WHERE x0_um IS NOT NULL AND y0_um IS NOT NULL AND x1_um IS NOT NULL AND y1_um IS NOT NULL GROUP BY 1, 2),
f AS (SELECT {_NAME.format("design")} AS design, {_S} AS scenario, ty, tx, {", ".join(_num(c) for c in (*FEATURES, "label_v"))} FROM features WHERE design IS NOT NULL AND scenario IS NOT NULL GROUP BY 1, 2, 3, 4),
r AS (SELECT {_D} AS design, {_S} AS scenario, fy, fx, max(drop_v) AS drop_v FROM irmap WHERE scenario IS NOT NULL AND drop_v BETWEEN 0 AND 0.2 AND NOT isnan(drop_v) GROUP BY 1, 2, 3, 4),
p AS (SELECT variant, seed, fold, {_NAME.format("design")} AS design, {_num("picp")}, {_num("mpiw_mv")} FROM picp_per_design WHERE design IS NOT NULL AND variant IS NOT NULL AND seed IS NOT NULL AND fold IS NOT NULL GROUP BY 1, 2, 3, 4)"""


def sql_tile(c: str, size: float, n: int) -> str:
    return f"least(greatest(cast(trunc({c} / ({size!r} / {n})) AS integer), 0), {n - 1})"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numbers rounded (and without negative zero), so that the order of sums cannot show. A small shift before
    keeps exact halves, which averages of short decimals often are, away from the edge."""
    return df.select(*((F.round(F.col(c) + F.lit(0.033 * 10**-digits), digits) + F.lit(0.0)).alias(c) if isinstance(df.schema[c].dataType, T.DoubleType) else F.col(c) for c in df.columns))


Query = Callable[[SparkSession, str], DataFrame]


class Register:
    """Queries with their SQL. ``sql`` lists key columns, number columns (rounded) and the body. ``digits`` None: rounds itself."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracle: dict[str, str] = {}

    def __call__(self, keys: str = "", numbers: str = "", body: str | None = None, ctes: str = "", digits: int | None = 6):
        def add(build: Callable[[Views], DataFrame]) -> Query:
            name = build.__name__

            def query(spark: SparkSession, sf: str) -> DataFrame:
                built = build(Views(spark, sf))
                return built if digits is None else rounded(built, digits)

            query.__name__, query.__doc__ = name, build.__doc__
            self.queries[name] = query
            if body:
                select = [*(f'cast({k} AS integer) AS {k}' if k in ("ty", "tx") else f'"{k}"' for k in keys.split()), *(f"round(cast({c} AS double) + {0.033 * 10**-digits!r}, {digits}) + 0.0 AS {c}" for c in numbers.split())]
                self.oracle[name] = f"WITH {BASE}{', ' + ctes if ctes else ''}\nSELECT {', '.join(select)} FROM (\n{body})"
            return query

        return add




__all__ = ["BASE", "BUDGET_V", "DIE", "FINE_N", "N", "VDD_V", "Register", "Views", "rounded", "sql_tile"]
