"""Compares a Spark query with its SQL in DuckDB, as the driver does."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def text(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows_of(columns: list[str], rows: list) -> list[str]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted("|".join(text(r[i]) for i in order) for r in rows)


def same(spark, con, query, sql: str, sf_dir: str) -> None:
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(list(want.columns), want.fetchall())
