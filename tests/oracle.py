"""Comparing a Spark result with DuckDB."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return c


def plain(v):
    """Lone floats to 12 digits, as sums differ in their order; whole numbers, texts and elements of arrays as they are."""
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    return tuple(v) if isinstance(v, list | tuple) else v


def assert_same(frame, connection, sql):
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    ours = sorted((tuple(plain(r[c]) for c in order) for r in frame.collect()), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert ours == theirs
