"""Run one registered query on Spark and its SQL on DuckDB and compare the values."""

from __future__ import annotations

import glob
import math
import os

import duckdb

from wardflow.plans import queries, oracle_sql


def connect(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("f", round(value, 6) + 0.0)
    if isinstance(value, int):
        return ("i", value)
    return (type(value).__name__, str(value))


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, folder: str) -> str | None:
    """None when both agree, otherwise a short description of the difference."""
    df = queries()[name](spark, folder)
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    res = con.sql(oracle_sql()[name])
    want_names, want = res.columns, res.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} != {sorted(want_names)}"
    a, b = _rows(got_names, got), _rows(want_names, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(wrong)} of {len(a)} rows differ, first {wrong[0]}" if wrong else None
