"""Run a registered query and its SQL on the same tables and compare."""

from __future__ import annotations

import math
import os
from datetime import datetime

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime):
        return value.isoformat()
    return str(value) if value.__class__.__name__ in ("Decimal", "UUID") else value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connection(folder=DATA):
    con = duckdb.connect()
    for name in sorted(os.listdir(folder)):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{folder}/{name}'")
    return con


def compare(spark, con, query, sql, folder=DATA):
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want = rows_of([c[0] for c in result.description], result.fetchall())
    assert sorted(df.columns) == sorted(c[0] for c in result.description)
    return got, want
