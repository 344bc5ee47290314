"""Queries of the general data problems: bad records (p3), orphan references (p4), packed values (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.names import clean_name
from gridloom.operators.orphan_references import orphan_references
from gridloom.operators.packed_values import quoted_values, split_packed
from gridloom.operators.record_errors import bad_records, loaded_records
from gridloom.session import stage, table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return bad_records(table(spark, sf, "raw_lines"), ["line_id"], "raw_line", "file_name").select("line_id", "reason")


def p3_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return loaded_records(table(spark, sf, "raw_lines"), ["line_id", "file_name"], "raw_line", "file_name")


def path_values(spark: SparkSession, sf: str, keys: list[str]) -> DataFrame:
    """The values packed in paths.inst_ids. Known values: ids and names of the instances of the same design, and what
    stands in quotes anywhere."""
    paths = table(spark, sf, "paths").withColumn("design", clean_name("design_id"))
    held = table(spark, sf, "instances").select(clean_name("design_id").alias("design"), F.explode(F.array(F.col("inst_id").cast("string"), "inst_name")).alias("value"))
    return split_packed(paths, "inst_ids", keys, [held, quoted_values(paths, "inst_ids", [])], "design", value="inst_value")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return path_values(spark, sf, ["row_id"])


REF_TABLES = ("activity", "macros", "paths")
MODULE, INSTANCE = 0, 1  # kinds of target


def reference_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All references of activity, macros and paths: ref (place in REF_TABLES), row_id, kind, design, ref_key, loaded_at.
    What is known of a table as a whole is a small number, since these rows are shuffled."""
    shape = lambda name, kind, key, df: df.select(F.lit(REF_TABLES.index(name)).alias("ref"), "row_id", F.lit(kind).alias("kind"), clean_name("design_id").alias("design"), key.alias("ref_key"), "loaded_at")
    values = path_values(spark, sf, ["row_id", "design_id", "loaded_at"]).where(F.col("inst_value").rlike(r"^[0-9]+\z"))
    values = stage(values.drop("pos"), "path-values")  # the references are read twice, by what the filter says of them
    plain = F.when(F.startswith("inst_value", F.lit("0")), F.regexp_replace("inst_value", "^0+(?=[0-9])", "")).otherwise(F.col("inst_value"))
    named = [shape(t, MODULE, clean_name("module"), table(spark, sf, t)) for t in ("activity", "macros")]
    return named[0].unionByName(named[1]).unionByName(shape("paths", INSTANCE, plain, values))


def parent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All targets: kind, design, ref_key, valid_from, valid_to."""
    shape = lambda kind, key, df: df.select(F.lit(kind).alias("kind"), clean_name("design_id").alias("design"), key.alias("ref_key"), F.col("loaded_at").alias("valid_from"), F.col("deleted_at").alias("valid_to"))
    return shape(MODULE, clean_name("module"), table(spark, sf, "modules")).unionByName(shape(INSTANCE, F.col("inst_id").cast("string"), table(spark, sf, "instances")))


def orphans(spark: SparkSession, sf: str) -> DataFrame:
    found = orphan_references(reference_rows(spark, sf), parent_rows(spark, sf), ["kind", "design", "ref_key"], "loaded_at", "valid_from", "valid_to")
    month = F.substring(F.col("loaded_at").cast("string"), 1, 7)
    rows = found.select("ref", "row_id", "ref_key", month.alias("ref_month"), "reason").distinct()  # a path may name an instance twice
    return rows.select(F.element_at(F.array(*map(F.lit, REF_TABLES)), F.col("ref") + 1).alias("ref_table"), "row_id", "ref_key", "ref_month", "reason")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans(spark, sf)


def p4_per_month(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references per table, month and reason."""
    return orphans(spark, sf).groupBy("ref_table", "ref_month", "reason").agg(F.count("*").alias("n_refs"), F.countDistinct("row_id").alias("n_rows"))


QUERIES = {q.__name__: q for q in (p3_found, p3_loaded, p4_found, p4_per_month, p5_found)}

_NAME = r"lower(regexp_replace({}, '^\s+|\s+$', '', 'g'))"
_VALUES = r"""
  SELECT {keys}, i AS pos, m[i] AS raw, CASE WHEN m[i][1] IN ('"', '''') THEN regexp_replace(replace(m[i][2:-2], m[i][1] || m[i][1], m[i][1]), '^[\s\x{{A0}}]+|[\s\x{{A0}}]+$', '', 'g') ELSE m[i] END AS v
  FROM (SELECT {keys}, regexp_extract_all(inst_ids, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[A-Za-z0-9_]+') AS m FROM paths WHERE inst_ids IS NOT NULL) t, unnest(range(1, len(m) + 1)) AS u(i)"""

_ORPHANS = rf"""
WITH refs AS (
  SELECT 'activity' AS ref_table, row_id, 'm' AS kind, {_NAME.format("design_id")} AS design, {_NAME.format("module")} AS ref_key, loaded_at FROM activity WHERE module IS NOT NULL
  UNION ALL SELECT 'macros', row_id, 'm', {_NAME.format("design_id")}, {_NAME.format("module")}, loaded_at FROM macros WHERE module IS NOT NULL
  UNION ALL SELECT 'paths', row_id, 'i', {_NAME.format("design_id")}, regexp_replace(v, '^0+([0-9])', '\1'), loaded_at
    FROM ({_VALUES.format(keys="row_id, design_id, loaded_at")}) WHERE regexp_full_match(v, '[0-9]+')),
parents AS (
  SELECT 'm' AS kind, {_NAME.format("design_id")} AS design, {_NAME.format("module")} AS ref_key, loaded_at AS a, deleted_at AS b FROM modules WHERE module IS NOT NULL
  UNION ALL SELECT 'i', {_NAME.format("design_id")}, cast(inst_id AS varchar), loaded_at, deleted_at FROM instances),
per AS (
  SELECT DISTINCT ref_table, row_id, r.kind, r.design, r.ref_key, r.loaded_at,
    bool_or(coalesce(a <= r.loaded_at AND (b IS NULL OR r.loaded_at < b), false)) AS sound, count(p.kind) AS n, min(a) AS first
  FROM refs r LEFT JOIN parents p ON r.kind = p.kind AND r.design = p.design AND r.ref_key = p.ref_key
  GROUP BY ref_table, row_id, r.kind, r.design, r.ref_key, r.loaded_at),
orphans AS (
  SELECT ref_table, row_id, ref_key, strftime(loaded_at, '%Y-%m') AS ref_month,
    CASE WHEN n = 0 THEN 'missing' WHEN first > loaded_at THEN 'late' ELSE 'deleted' END AS reason FROM per WHERE NOT sound)
"""

_RECORDS = r"""
WITH core AS (SELECT line_id, file_name, regexp_replace(regexp_replace(coalesce(raw_line, ''), '^\x{FEFF}', ''), '\r+$', '') AS s FROM raw_lines),
cut AS (SELECT *, regexp_extract_all(s, '("(?:[^"]|"")*"|[^",]*)(?:,|$)', 1) AS raw, CASE file_name WHEN 'activity' THEN 4 ELSE 3 END AS want,
    regexp_full_match(s, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*') AS sound,
    len(regexp_replace(regexp_replace(s, '"(?:[^"]|"")*"', 'q', 'g'), '[^,]', '', 'g')) + 1 AS n FROM core),
fields AS (SELECT *, list_transform(raw[1:want], lambda x: regexp_replace(CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END, '^[\s\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g')) AS f FROM cut),
valued AS (SELECT *, list_transform(f, lambda x: regexp_full_match(x, '[+-]?[0-9]+')) AS whole,
    list_transform(f, lambda x: CASE WHEN regexp_full_match(x, '[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?') THEN cast(x AS double) ELSE -1 END) AS v FROM fields),
judged AS (SELECT *, CASE
    WHEN NOT sound THEN 'quoting'
    WHEN regexp_full_match(s, '[\s\v\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]*') OR n <> want THEN 'column_count'
    WHEN NOT CASE file_name
      WHEN 'strap_planned' THEN whole[1] AND whole[2] AND v[1] BETWEEN 0 AND 95 AND v[2] BETWEEN 0 AND 95 AND v[3] BETWEEN 0 AND 1
      WHEN 'activity' THEN f[1] <> '' AND f[2] <> '' AND v[3] BETWEEN 0 AND 1 AND v[4] BETWEEN 0 AND 1
      ELSE whole[1] AND v[1] >= 0 AND v[2] >= 0 AND v[3] >= 0 END THEN 'value' END AS reason FROM valued)
"""

ORACLE = {
    "p3_found": _RECORDS + "SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p3_loaded": _RECORDS + """SELECT line_id, file_name,
      CASE WHEN file_name = 'strap_planned' THEN cast(v[1] AS integer) END AS fy, CASE WHEN file_name = 'strap_planned' THEN cast(v[2] AS integer) END AS fx,
      CASE WHEN file_name = 'strap_planned' THEN v[3] END AS density, CASE WHEN file_name = 'activity' THEN f[1] END AS scenario, CASE WHEN file_name = 'activity' THEN f[2] END AS module,
      CASE WHEN file_name = 'activity' THEN v[3] END AS activity, CASE WHEN file_name = 'activity' THEN v[4] END AS mission_weight,
      CASE WHEN file_name = 'bumps' THEN cast(v[1] AS bigint) END AS bump_id, CASE WHEN file_name = 'bumps' THEN v[2] END AS x_um, CASE WHEN file_name = 'bumps' THEN v[3] END AS y_um
      FROM judged WHERE reason IS NULL""",
    "p5_found": f"SELECT row_id, cast(row_number() OVER (PARTITION BY row_id ORDER BY pos) AS integer) AS pos, v AS inst_value FROM ({_VALUES.format(keys='row_id')}) WHERE v <> ''",
    "p4_found": _ORPHANS + "SELECT ref_table, row_id, ref_key, ref_month, reason FROM orphans",
    "p4_per_month": _ORPHANS + "SELECT ref_table, ref_month, reason, count(*) AS n_refs, count(DISTINCT row_id) AS n_rows FROM orphans GROUP BY ALL",
}
