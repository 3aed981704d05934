"""Rows of a query against rows of its SQL in DuckDB: counts, columns and values without order."""

from __future__ import annotations

import math
import os
from collections import Counter
from decimal import Decimal


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in sorted(os.listdir(sf_dir)):
        if name.endswith(".parquet"):
            path = os.path.join(sf_dir, name)
            path = os.path.join(path, "*.parquet") if os.path.isdir(path) else path
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if hasattr(v, "tzinfo") and v is not None and v.tzinfo is not None:
        from datetime import timezone

        return v.astimezone(timezone.utc).replace(tzinfo=None)
    return v


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def difference(df, con, sql: str) -> tuple[int, int, list, list]:
    """Row counts of both, and rows only one of them has."""
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    theirs, ours = bag(names, cur.fetchall()), bag(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        return sum(ours.values()), sum(theirs.values()), [("columns", sorted(df.columns))], [("columns", sorted(names))]
    return sum(ours.values()), sum(theirs.values()), list((ours - theirs).elements()), list((theirs - ours).elements())
