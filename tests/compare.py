"""Spark and DuckDB results as comparable rows."""

import glob
import math
import os
from decimal import Decimal


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(plain(v[i]) for i in order)) for v in values)


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def duckdb_rows(sql, folder):
    import duckdb

    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    r = con.sql(sql)
    return rows(r.columns, r.fetchall())
