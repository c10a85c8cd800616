"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    if isinstance(v, list | tuple):
        return tuple(map(norm, v))
    return v


def connect(folder):
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in os.listdir(folder):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{folder}/{t}'")
    return c


def compare(df, rel):
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert mine == theirs
