"""Runs a query and its DuckDB twin and compares their rows by column name."""

import decimal
import glob
import os

import duckdb


def cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows_of(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def twin(sql, root):
    c = duckdb.connect()
    for p in glob.glob(f"{root}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{at}'")
    return c.sql(sql)


def check(spark, query, sql, root):
    got, want = query(spark, root), twin(sql, root)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.collect(), got.columns) == rows_of(want.fetchall(), want.columns)
