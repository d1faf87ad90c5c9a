"""Compares a query with its SQL on DuckDB: columns by name, rows in any order."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.12g}")
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(map(_cell, x))
    return x


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[c]) for c in names) for r in df.collect()), key=repr)


def sql_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).iterdir():
        at = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{at}')")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    order = [rel.columns.index(c) for c in names]
    return names, sorted((tuple(_cell(r[i]) for i in order) for r in rel.fetchall()), key=repr)
