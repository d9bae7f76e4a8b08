"""Compare a Spark result with its SQL run by DuckDB on the same files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return 0.0 if v == 0 and isinstance(v, float) else v


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i].lower())
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if names, types and values agree exactly."""
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(map(str.lower, names)) != sorted(map(str.lower, df.columns)):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = _rows(df.columns, [tuple(r) for r in got]), _rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    kinds = [{type(v) for r in rows for v in r} - {type(None)} for rows in (a, b)]
    if a and b and kinds[0] != kinds[1]:
        return f"types {kinds[0]} != {kinds[1]}"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None
