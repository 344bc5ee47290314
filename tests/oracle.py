"""Compares a query with its SQL in DuckDB, as sets of rows with their number."""

import os

import duckdb


def connect(directory):
    con = duckdb.connect()
    for t in os.listdir(directory):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from read_parquet('{directory}/{t}{'/*.parquet' if os.path.isdir(f'{directory}/{t}') else ''}')")
    return con


def canonical(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    text = lambda v: "null" if v is None or v != v else repr(float(v) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(text(r[i]) for i in at) for r in rows)


def same(spark_df, con, sql):
    got = canonical([tuple(r) for r in spark_df.collect()], spark_df.columns)
    rel = con.execute(sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(spark_df.columns)
    assert got == canonical(rel.fetchall(), columns)
