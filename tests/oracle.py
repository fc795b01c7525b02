"""Runs every query with SQL beside DuckDB and compares rows."""

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        found = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(found):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{found}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def compare(spark, con, name, build, sql, data):
    df = build(spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    assert sorted(names) == sorted(df.columns), (name, names, df.columns)
    assert len(got) == len(want), (name, len(got), len(want))
    assert got == want, (name, [(a, b) for a, b in zip(got, want) if a != b][:2])
    return len(got)
