"""Rows of a DataFrame against rows of SQL, as DuckDB gives them on the same files."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def value(x):
    """One form for what both sides may write differently: numbers, times, nested values."""
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float, decimal.Decimal)):
        return f"{float(x):.9g}" if float(x) else "0"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return "{" + ",".join(f"{k}:{value(x[k])}" for k in sorted(x)) + "}"
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(value, x)) + "]"
    return str(x)


def differences(df, sql: str, sf_dir: str) -> tuple[list, list, int]:
    """(rows only in df, rows only in SQL's result, rows of both)."""
    names = sorted(df.columns)
    ours = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cur = con.execute(sql)
    found = [d[0] for d in cur.description]
    assert sorted(found) == names, f"columns {sorted(found)}, not {names}"
    order = [found.index(c) for c in names]
    theirs = sorted(tuple(value(r[i]) for i in order) for r in cur.fetchall())
    only, others = list(ours), []
    from collections import Counter

    a, b = Counter(only), Counter(theirs)
    others = list((b - a).elements())
    return list((a - b).elements()), others, len(theirs)
