"""A query's rows against those of its SQL in DuckDB."""

import glob
import math
import os
from decimal import Decimal

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x):
    if isinstance(x, (float, Decimal)):
        x = float(x)
        return None if math.isnan(x) else float(f"{x:.9g}")
    return x


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in data), key=repr)


def compare(spark, run, sql, sf=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = run(spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
    return len(got)
