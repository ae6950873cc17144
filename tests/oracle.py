"""Runs queries beside their oracles over one folder of tables."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(v[k]) for k in order) for v in values), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str | None:
    """What differs, or None."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    mine = rows(got.columns, got.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows(names, cur.fetchall())
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"{len(mine)} and {len(theirs)} rows; only ours {sorted(a, key=repr)[:2]}; only theirs {sorted(b, key=repr)[:2]}"
    return None
