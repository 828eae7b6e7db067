"""Runs a query and its DuckDB statement on the same tables and compares names and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytearray, memoryview)):
        return bytes(v)
    return v


def compare(df, con, sql):
    names = sorted(df.columns)
    have = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    assert sorted(columns) == names, (sorted(columns), names)
    want = sorted((tuple(plain(r[columns.index(n)]) for n in names) for r in got.fetchall()), key=str)
    assert len(have) == len(want), (len(have), len(want))
    for h, w in zip(have, want, strict=True):
        assert h == w, (names, h, w)
    return len(have)
