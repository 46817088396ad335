"""Comparison of a Spark query with its oracle statement."""

import datetime
import glob
import math
import os
from decimal import Decimal

import duckdb


def connection(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, Decimal)) or isinstance(value, int) and abs(value) < 10**6:
        return f"{float(value):.6g}"
    if isinstance(value, (datetime.date, datetime.datetime)):
        return str(value)[:19]
    return str(value)


def same(df, con, sql):
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = sorted(tuple(plain(dict(zip(names, row))[c]) for c in sorted(names)) for row in result.fetchall())
    assert columns == sorted(names)
    assert ours == theirs
