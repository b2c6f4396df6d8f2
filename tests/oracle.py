"""Compares registered queries with their SQL on the tables of a scale."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf_dir}/{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, decimal.Decimal):
        return plain(float(x))
    if isinstance(x, bool) or x is None or isinstance(x, (str, datetime.datetime)):
        return x
    return int(x) if isinstance(x, int) else x


def rows(names: list[str], data) -> list[tuple]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(df, con, sql: str) -> str:
    """Empty if the results are equal."""
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want = rows(want_names, cur.fetchall())
    got = rows(df.columns, df.collect())
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, not {sorted(want_names)}"
    if len(got) != len(want):
        return f"{len(got)} rows, not {len(want)}; e.g. {[x for x in got if x not in set(want)][:2]} / {[x for x in want if x not in set(got)][:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""
