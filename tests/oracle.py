"""Holds queries against their SQL in DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(x):
    if hasattr(x, "item"):
        x = x.item()
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "~"
    return repr(round(x, 6)) if isinstance(x, float) else repr(x)


def same(df, connection, sql):
    """Columns and rows that differ, as text; empty if none."""
    want = connection.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = sorted(names)
    a = sorted(tuple(_plain(r[c]) for c in order) for r in df.collect())
    b = sorted(tuple(_plain(r[names.index(c)]) for c in order) for r in want.fetchall())
    if a == b:
        return ""
    left, right = set(a) - set(b), set(b) - set(a)
    return f"{len(a)} and {len(b)} rows, {len(left)} and {len(right)} differ: {sorted(left)[:2]} {sorted(right)[:2]} of {order}"
