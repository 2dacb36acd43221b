"""Compare a Spark query with DuckDB SQL on the same tables: columns by name, rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if hasattr(v, "normalize"):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql: str, sf_dir: str):
    import duckdb

    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for t in TABLES:
        if (p := Path(sf_dir) / f"{t}.parquet").exists():
            c.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
