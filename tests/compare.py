"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return ("decimal", str(value))
    if isinstance(value, float):
        return "nan" if math.isnan(value) else ("float", repr(value))
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return value


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Empty if both sides hold the same columns and the same rows."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    order = sorted(names)
    right = Counter(
        tuple(_plain(row[names.index(n)]) for n in order) for row in result.fetchall()
    )
    left = Counter(tuple(_plain(row[n]) for n in order) for row in df.collect())
    found = [f"rows {sum(left.values())} against {sum(right.values())}"] if sum(left.values()) != sum(right.values()) else []
    found += [f"only spark: {row}" for row in list((left - right))[:2]]
    found += [f"only duckdb: {row}" for row in list((right - left))[:2]]
    return found
