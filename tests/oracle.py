"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET timezone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(x):
    if x is None or x != x:
        return ""
    if isinstance(x, Decimal):
        x = float(x)
    if isinstance(x, float):
        return f"{x + 0.0:.8g}" if not math.isinf(x) else str(x)
    if isinstance(x, int) and not isinstance(x, bool):
        return f"{x:.8g}" if abs(x) < 10**7 else str(x)
    return str(x)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def same(spark, sf: str, query, sql: str) -> None:
    df = query(spark, sf)
    rel = connect(sf).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert mine == theirs, (len(mine), len(theirs), [x for x in mine if x not in theirs][:3], [x for x in theirs if x not in mine][:3])
