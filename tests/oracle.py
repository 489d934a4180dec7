"""Compares a Spark result with DuckDB's, regardless of order."""

import math
from collections import Counter
from pathlib import Path

import duckdb


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo"):
        return str(v.replace(tzinfo=None))
    return tuple(map(normal, v)) if isinstance(v, list) else v


def counted(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    return Counter(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def duck(directory):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in Path(directory).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    ours, theirs = counted([tuple(r) for r in df.collect()], df.columns), counted(cur.fetchall(), names)
    assert ours == theirs, (list((ours - theirs))[:3], list((theirs - ours))[:3])
