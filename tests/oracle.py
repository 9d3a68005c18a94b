"""Runs a query and its oracle and compares columns, kinds of values and rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def plain(x):
    if isinstance(x, bool) or x is None or isinstance(x, (str, bytes)):
        return x
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 7) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(columns, values) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def difference(spark, db, run, sql: str, sf_dir: str) -> str:
    """Empty if the query and the oracle agree."""
    df = run(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    result = db.execute(sql)
    columns = [c[0] for c in result.description]
    theirs = rows(columns, result.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows and {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{sorted(columns)}: {str(a)[:400]} and {str(b)[:400]}"
    return ""
