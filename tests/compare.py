"""Rows of a Spark query against rows of its SQL in DuckDB, as sorted lists."""

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    return "null" if x is None else str(x)


def rows_of(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def same(df, con, sql: str) -> int:
    """Asserts that both give the same rows under the same names; how many there are."""
    got = con.execute(sql)
    names, want = rows_of([d[0] for d in got.description], got.fetchall())
    have_names, have = rows_of(df.columns, df.collect())
    assert have_names == names
    assert len(have) == len(want), (len(have), len(want))
    diff = [(a, b) for a, b in zip(have, want, strict=True) if a != b]
    assert not diff, diff[:3]
    return len(have)
