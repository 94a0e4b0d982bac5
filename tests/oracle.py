"""Compare a query with its SQL counterpart."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return f"{v:.5f}" if isinstance(v, float) else str(v)


def compare(spark, sf, run, sql):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = run(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({sql})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    key = lambda rows: sorted(tuple(norm(v) for v in r) for r in rows)
    assert key(got) == key(want)
