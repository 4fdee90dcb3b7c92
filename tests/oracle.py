"""Comparing a registered query with its SQL in DuckDB on the same tables."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connect(base: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{base}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql):
    mine = counted(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    theirs = counted([c[0] for c in res.description], res.fetchall())
    assert mine[0] == theirs[0], (mine[0], theirs[0])
    return list((mine[1] - theirs[1]).items())[:5], list((theirs[1] - mine[1]).items())[:5], sum(mine[1].values())
