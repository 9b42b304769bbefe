"""Compares a registered query with its SQL, as sorted rows with rounded doubles."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return "\0" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def run_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def difference(df, sql: str, sf_dir: str) -> str | None:
    """What differs, or nothing."""
    cols, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    theirs_cols, theirs = run_sql(sql, sf_dir)
    if cols != theirs_cols:
        return f"columns {cols} and {theirs_cols}"
    if mine != theirs:
        odd = [x for x in zip(mine, theirs) if x[0] != x[1]][:2]
        return f"{len(mine)} and {len(theirs)} rows; first differences {str(odd)[:600]}"
    return None
