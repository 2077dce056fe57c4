"""Runs queries against their SQL in DuckDB and says where they differ."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    return con


def plain(v):
    if v is None:
        return ""
    if isinstance(v, bool):
        return f"b{v}"
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day).isoformat()
    return str(v)


def differences(query, sql: str, spark, folder: str, con) -> str:
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = sorted(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    rel = con.sql(sql)
    at = [rel.columns.index(n) if n in rel.columns else -1 for n in names]
    if -1 in at or len(rel.columns) != len(names):
        return f"columns {names} and {sorted(rel.columns)}"
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; only Spark {sorted(a)[:3]}; only SQL {sorted(b)[:3]}"
    return ""
