"""Compares a query with its SQL on DuckDB, as sorted rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in data), key=repr)


def differences(spark_df, sql: str, c):
    r = c.execute(sql)
    theirs = rows([d[0] for d in r.description], r.fetchall())
    ours = rows(spark_df.columns, [tuple(x) for x in spark_df.collect()])
    a, b = set(map(repr, ours)), set(map(repr, theirs))
    return len(ours), len(theirs), sorted(a - b)[:3], sorted(b - a)[:3], sorted(spark_df.columns) == sorted(d[0] for d in r.description)
