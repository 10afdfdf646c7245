"""Runs a query and its SQL twin over the same tables and compares their rows."""

from __future__ import annotations

import decimal
import glob

import numpy as np


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def compare(spark, sf, query, sql):
    import duckdb

    df = query(spark, sf)
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())
