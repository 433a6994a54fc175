"""Runs a query and its SQL side by side on the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(base) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return str(value)


def sorted_rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, base: str, query, sql: str) -> list[str]:
    """What differs between the two results, as readable lines; empty when they agree."""
    df = query(spark, base)
    con = connect(base)
    try:
        cursor = con.execute(sql)
        names = [d[0] for d in cursor.description]
        theirs = sorted_rows(names, cursor.fetchall())
    finally:
        con.close()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    ours = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows != {len(theirs)}"]

    def close(a, b) -> bool:
        if isinstance(a, float) and isinstance(b, float):
            return abs(a - b) <= 2e-6
        return a == b

    return [
        f"{x} != {y}"
        for x, y in zip(ours, theirs)
        if not all(close(a, b) for a, b in zip(x, y))
    ]
