"""Comparison of frames with DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

DATA = "/root/testdata/sf0.001"


def plain(value):
    """A value in a form in which equal ones of both engines are equal."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return str(value)


def rows_of(df) -> list:
    columns = sorted(df.columns)
    return sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())


def duck(sql: str, data: str = DATA):
    import duckdb

    con = duckdb.connect()
    for path in Path(data).iterdir():
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda k: found.columns[k])
    return sorted(found.columns), sorted(repr([plain(r[k]) for k in order]) for r in found.fetchall())


def same(df, sql: str, data: str = DATA) -> None:
    columns, rows = duck(sql, data)
    assert sorted(df.columns) == columns
    assert rows_of(df) == rows
