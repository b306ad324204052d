"""Compare a query with its SQL twin, rows as a bag and floats to four places."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4)
    if hasattr(v, "asDict") or isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    return round(float(v), 4) if hasattr(v, "quantize") else v


def connect(folder):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def same(df, con, sql):
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(x) for x in r)) for r in df.select(*columns).collect())
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(repr(tuple(plain(row[i]) for i in at)) for row in r.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
