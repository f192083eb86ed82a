"""Run a registered query and its SQL twin and compare rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def compare(spark, name, query, sql, sf_dir):
    """None when equal, else a message."""
    got = query(spark, sf_dir)
    cols = sorted(got.columns)
    left = [tuple(_plain(x) for x in r) for r in got.select(*cols).collect()]
    res = duck(sf_dir).execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} != {sorted(names)}"
    order = [names.index(c) for c in cols]
    right = [tuple(_plain(r[i]) for i in order) for r in res.fetchall()]
    if sorted(map(repr, left)) != sorted(map(repr, right)):
        a, b = set(map(repr, left)), set(map(repr, right))
        return (
            f"{name}: {len(left)} vs {len(right)} rows; columns {cols}\n  only spark: {sorted(a - b)[:3]}\n  only sql: {sorted(b - a)[:3]}"
        )
    return None if left else f"{name}: no rows"
