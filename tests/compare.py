"""Comparison of a Spark result with DuckDB on the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{root}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = _rows(names, found.fetchall())
    ours = _rows(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if not theirs:
        return "the SQL gives no rows"
    if ours != theirs:
        left, right = list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; ours {left}; theirs {right}"
    types = {d[0]: str(d[1]) for d in con.execute(sql).description}
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    wrong = [f"{n}: {t} and {types[n]}" for n, t in df.dtypes if kinds.get(t, t) != types[n]]
    return f"types {wrong}" if wrong else None
