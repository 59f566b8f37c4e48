"""Compares queries with their SQL over one scale of the test tables."""

import datetime
import decimal
import os
from collections import Counter

import duckdb


def one(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "NULL" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return str([one(x) for x in v])
    if isinstance(v, datetime.datetime):
        return str(v.replace(tzinfo=None))
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(one(r[i]) for i in order) for r in data)


def connect(d):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in os.listdir(d):
        con.execute(f"create view {t[:-8]} as select * from '{d}/{t}'")
    return con


def same(spark, con, d, query, sql):
    df = query(spark, d)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    c = con.execute(sql)
    want = rows([x[0] for x in c.description], c.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1], (list((got[1] - want[1]).items())[:3], list((want[1] - got[1]).items())[:3])
