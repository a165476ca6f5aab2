"""Comparing a query with its SQL over the same tables."""

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def assert_equal(df, con, sql: str) -> None:
    """Same column names, same rows as multisets, same kind of values."""
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    res = con.sql(sql)
    assert sorted(res.columns) == names
    at = [res.columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert got == want, (list((got - want).items())[:5], list((want - got).items())[:5], got.total(), want.total())
