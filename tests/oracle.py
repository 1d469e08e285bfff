"""Runs a query's SQL in DuckDB over the same tables and compares values, order aside."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def norm(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if type(v).__name__ == "Decimal":
        return round(float(v), 4)
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.isoformat() if hasattr(v, "isoformat") else v


def same(df, c, sql: str) -> tuple[list, list]:
    got = c.sql(sql)
    columns, rows = got.columns, got.fetchall()
    assert sorted(columns) == sorted(df.columns)
    theirs = [tuple(norm(dict(zip(columns, r))[k]) for k in sorted(columns)) for r in rows]
    ours = [tuple(norm(r[k]) for k in sorted(columns)) for r in df.collect()]
    return sorted(map(repr, ours)), sorted(map(repr, theirs))
