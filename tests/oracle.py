"""Rows of a query against rows of its SQL in DuckDB, whatever their order."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, (float, Decimal)):
        return None if isinstance(v, float) and math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in values)


def agrees(df, sql: str, sf_dir: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    ours, theirs = rows(df.columns, [tuple(r) for r in df.collect()]), rows(rel.columns, rel.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
