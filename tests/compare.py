"""Compare a query's rows with its SQL on DuckDB, regardless of order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, bool):
        return str(value)
    return None if value is None else str(value)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_normal(row[i]) for i in order) for row in rows),
        key=lambda row: tuple((v is None, v or "") for v in row),
    )


def differences(df, connection, sql: str, shown: int = 3) -> list[str]:
    """Empty when columns and rows agree."""
    cursor = connection.execute(sql)
    expected_columns = [d[0] for d in cursor.description]
    if sorted(df.columns) != sorted(expected_columns):
        return [f"columns {sorted(df.columns)} expected {sorted(expected_columns)}"]
    expected = _rows(expected_columns, cursor.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    problems = []
    if len(actual) != len(expected):
        problems.append(f"{len(actual)} rows, expected {len(expected)}")
    if actual != expected:
        names = sorted(df.columns)
        extra = set(actual) - set(expected)
        lacking = set(expected) - set(actual)
        for a, b in list(zip(sorted(extra, key=str), sorted(lacking, key=str)))[:shown]:
            problems.append(str([(n, x, y) for n, x, y in zip(names, a, b) if x != y]))
        problems.append(f"{len(extra)} unexpected, {len(lacking)} missing")
    return problems
