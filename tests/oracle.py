"""Compares a query with its SQL, as multisets of rows."""

import os
from collections import Counter

import duckdb


def connect(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return c


def _value(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool):
        return v
    return round(float(v), 9) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return Counter(tuple(_value(v) for v in r) for r in frame.itertuples(index=False, name=None))


def assert_same(df, sql, sf_dir):
    with connect(sf_dir) as c:
        expected = c.execute(sql).df()
    got = df.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)
