"""Runs a query and its SQL and says where they differ."""

import os

import duckdb


def connection(d: str):
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"create view {f.replace('.parquet', '')} as select * from '{d}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(df, con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(df.columns)
    assert sorted(names) == cols
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    b = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    return a, b
