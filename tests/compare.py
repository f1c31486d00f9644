"""Side-by-side run of a query and its SQL."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return [_plain(x) for x in v]
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(_plain(r[i])) for i in order) for r in rows)


def difference(df, con, sql) -> str | None:
    """None if both give the same columns and rows, else the first differences."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    want = rows_of(names, result.fetchall())
    if got == want:
        return None
    only = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{sorted(names)}: {len(got)} != {len(want)} rows; only Spark {only[0]}; only SQL {only[1]}"
