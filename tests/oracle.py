"""Compares a query with its SQL in DuckDB: columns, types and rows in any order."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def connect(folder: str):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return c


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def compare(df, sql: str, folder: str) -> None:
    columns = sorted(df.columns)
    rows = sorted(str([_plain(r[c]) for c in columns]) for r in df.collect())
    q = connect(folder).sql(sql)
    assert sorted(q.columns) == columns
    at = [q.columns.index(c) for c in columns]
    assert rows == sorted(str([_plain(r[i]) for i in at]) for r in q.fetchall())
    kinds, there = dict(df.dtypes), dict(zip(q.columns, map(str, q.types)))
    assert {c: KINDS.get(kinds[c], kinds[c]) for c in columns} == {c: there[c] for c in columns}
