"""Comparing a Spark result with the same query in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def bag(frame) -> list[tuple]:
    columns = sorted(frame.columns)
    return sorted(frame[columns].itertuples(index=False, name=None), key=repr)


def same(spark_df, con, sql: str) -> tuple[bool, str]:
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    types = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns}
    wrong = {c: t for c, t in types.items() if t[0] != t[1]}
    if wrong and len(got):
        return False, f"types {wrong}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}"
    a, b = bag(got), bag(want)
    return (True, f"{len(a)} rows") if a == b else (False, f"values, e.g. {next(p for p in zip(a, b) if p[0] != p[1])}")
