"""Runs a registered query on Spark and its SQL on DuckDB and compares them as bags of rows."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def canonical(row: dict) -> tuple:
    def plain(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        return repr(v)

    return tuple(plain(row[k]) for k in sorted(row))


def differences(spark_df, con, sql: str) -> list[str]:
    relation = con.sql(sql)
    names = relation.columns
    expected = [dict(zip(names, r)) for r in relation.fetchall()]
    actual = [r.asDict() for r in spark_df.collect()]
    notes = []
    if sorted(names) != sorted(spark_df.columns):
        notes.append(f"columns {sorted(spark_df.columns)} vs {sorted(names)}")
        return notes
    if len(actual) != len(expected):
        notes.append(f"rows {len(actual)} vs {len(expected)}")
    left, right = sorted(map(canonical, actual)), sorted(map(canonical, expected))
    if left != right:
        a, b = set(left), set(right)
        notes.append(f"values differ: {len(a - b)} vs {len(b - a)}; {sorted(a - b)[:2]} | {sorted(b - a)[:2]}")
    return notes
