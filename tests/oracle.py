"""Compare one query with its SQL the way the driver does."""

from __future__ import annotations

import datetime
import math
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, int):
        return f"i:{v}"
    if isinstance(v, (float, Decimal)):
        return f"f:{float(v) + 0.0!r}"
    if isinstance(v, datetime.datetime):
        return f"t:{v.isoformat()}"
    if isinstance(v, datetime.date):
        return f"d:{v.isoformat()}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return f"s:{v}"


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf, fn, sql, con=None) -> str | None:
    """None when equal, else what differs."""
    df = fn(spark, sf)
    a_names, a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = (con or connect(sf)).execute(sql)
    names = [d[0] for d in cur.description]
    b_names, b = rows_of(names, cur.fetchall())
    if a_names != b_names:
        return f"columns {a_names} != {b_names}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; first {a[:1]} | {b[:1]}"
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        sa, sb = set(a), set(b)
        return f"{len(bad)} of {len(a)} rows differ; only spark {sorted(sa - sb)[:2]} | only sql {sorted(sb - sa)[:2]} | columns {a_names}"
    if not a:
        return "both empty"
    return None
