"""Runs a query in Spark and its SQL in DuckDB and compares names, rows and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5)
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(_plain(y) for y in x)
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, f, sql):
    df = f(spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    want = rows_of([c[0] for c in res.description], res.fetchall())
    assert got[0] == want[0], f"columns {got[0]} and {want[0]}"
    assert len(got[1]) == len(want[1]), f"rows {len(got[1])} and {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    assert not bad, f"{len(bad)} rows differ, first {str(bad[0])[:600]}"
    return len(got[1])
