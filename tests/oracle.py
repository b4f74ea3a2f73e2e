"""A query's rows against its SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os


def normal(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        return normal(v.item())
    if isinstance(v, bool | int):
        return int(v)
    return round(v, 6) if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([normal(r[i]) for i in order]) for r in data)


def check(spark, directory, query, sql):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{directory}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    got, want = query(spark, directory), con.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
