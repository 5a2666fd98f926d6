"""Compares registered queries with their SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

from threadloom.registry.adapters import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_value(r[i]) for i in order) for r in rows)


def _kinds(names, rows) -> dict:
    kinds = {}
    for i, n in enumerate(names):
        kinds[n] = {type(r[i]).__name__ for r in rows if r[i] is not None}
    return kinds


LAST_ROWS = {"n": 0}


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    cursor = con.execute(sql)
    theirs_names, theirs = [d[0] for d in cursor.description], cursor.fetchall()
    ours_names, ours = df.columns, [tuple(r) for r in df.collect()]
    LAST_ROWS["n"] = len(ours)
    if sorted(theirs_names) != sorted(ours_names):
        return f"columns {sorted(ours_names)} != {sorted(theirs_names)}"
    ok, tk = _kinds(ours_names, ours), _kinds(theirs_names, theirs)
    wrong = {n: (ok[n], tk[n]) for n in ok if ok[n] and tk[n] and ok[n] != tk[n]}
    if wrong:
        return f"types {wrong}"
    a, b = _rows(ours_names, ours), _rows(theirs_names, theirs)
    if a != b:
        return f"rows {len(ours)} vs {len(theirs)}; only ours {list((a - b))[:2]}; only SQL {list((b - a))[:2]}"
    return None
