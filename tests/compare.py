"""Spark result against DuckDB over the same Parquet files."""

import math

import duckdb

from colquery.catalog import TABLES


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    return sorted(cols), rows_of(cols, cur.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows_of(df.columns, df.collect())
