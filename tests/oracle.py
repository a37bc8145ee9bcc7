"""Compare a query with its SQL as the driver does: columns by name, rows as a multiset."""

from __future__ import annotations

import glob
import os
from collections import Counter

import duckdb


def connection(sf_dir: str):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def value(x):
    return round(x, 6) if isinstance(x, float) else x


def rows(names, data) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(value(r[i]) for i in order) for r in data)


def compare(c, df, sql: str) -> str:
    """'' if equal, else what differs."""
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    want = rows(names, r.fetchall())
    got = rows(df.columns, [tuple(x) for x in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(names)}"
    if not want:
        return "the oracle has no rows"
    if want != got:
        return f"{sum(got.values())} rows instead of {sum(want.values())}; too many: {list((got - want).items())[:3]}; missing: {list((want - got).items())[:3]}"
    return ""
