"""Compare a Spark result with what DuckDB makes of the same tables, as multisets of rows."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((plain(a), plain(b)) for a, b in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if hasattr(v, "year"):
        return str(v)
    if isinstance(v, float) and not math.isfinite(v):
        return repr(v)
    return round(float(v), 9)


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str:
    """Empty if both have the same columns and rows, else what differs."""
    columns, mine = rows_of(df.columns, df.collect())
    found = con.execute(sql)
    theirs_columns, theirs = rows_of([d[0] for d in found.description], found.fetchall())
    if columns != theirs_columns:
        return f"columns {columns} and {theirs_columns}"
    if mine != theirs:
        return f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:2]}; only there {list((theirs - mine).items())[:2]}"
    return "" if mine else "no rows"
