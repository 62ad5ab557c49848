"""Holds registered queries against their SQL, as sets of normalised rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def norm(v):
    if v is None or isinstance(v, (bool, str, bytes)):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def differences(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if mine != theirs:
        only = [r for r in mine if r not in set(theirs)][:2] if len(mine) < 100_000 else []
        other = [r for r in theirs if r not in set(mine)][:2] if len(theirs) < 100_000 else []
        return f"{len(mine)} and {len(theirs)} rows; {only} {other}"
    return ""
