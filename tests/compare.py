"""Runs a query and its SQL and compares all rows."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def connection(folder):
    c = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(plain(x) for x in r) for r in df.select(*cols).collect())


def rows_of_sql(c, sql):
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
