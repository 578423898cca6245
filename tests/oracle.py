"""Runs a query here and its SQL in DuckDB, and compares the rows as bags."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def compare(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """Empty if equal, else what differs."""
    ours = query(spark, sf_dir)
    names = sorted(ours.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in ours.collect())
    rel = (con or connect(sf_dir)).execute(sql)
    theirs = [d[0] for d in rel.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if got == want:
        return ""
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
