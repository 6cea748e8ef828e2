"""Compare a query with its SQL: names, row counts and values, whatever the order."""

from __future__ import annotations

import os
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        name = f"{f}/*.parquet" if f.is_dir() else str(f)
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{name}')")
    return c


def rows(names: list[str], values) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(row[i] for i in order) for row in values)


def difference(spark, query, sql: str, sf_dir: str) -> str:
    """Empty if both give the same rows."""
    df = query(spark, sf_dir)
    got = rows(df.columns, map(tuple, df.collect()))
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    want = rows(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return ""


SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
