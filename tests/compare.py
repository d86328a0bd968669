"""Rows of a query and of its SQL in a form that can be compared."""

from __future__ import annotations

import glob
import math
import os

DATA = os.environ.get("QUERY_TEST_DATA", "/root/testdata/sf0.001")


def plain(x):
    if x is None:
        return "~null"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 6) + 0.0)
    if isinstance(x, (list, tuple)):
        return str([plain(y) for y in x])
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def check(spark, con, name, query, sql):
    got = query(spark, DATA)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(got.columns), name
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(names, cur.fetchall()), name
