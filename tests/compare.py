"""Compare a Spark result with DuckDB rows, columns by name, order ignored."""

from __future__ import annotations

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{directory}/{table}.parquet'")
    return connection


def _sorted(rows: list[tuple]) -> list[tuple]:
    return sorted(rows, key=lambda row: tuple((v is not None, str(v)) for v in row))


_TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def mismatch(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    columns = sorted(result.columns)
    relation = connection.execute(sql)
    described = {name: str(kind) for name, kind, *_ in relation.description}
    if sorted(described) != columns:
        return f"columns {columns} expected {sorted(described)}"
    order = [list(described).index(c) for c in columns]
    expected = _sorted([tuple(row[i] for i in order) for row in relation.fetchall()])
    actual = _sorted([tuple(row) for row in result.select(*columns).collect()])
    kinds = connection.execute(f"DESCRIBE {sql}").fetchall()
    expected_types = {row[0]: row[1] for row in kinds}
    actual_types = {c: _TYPES.get(t, t) for c, t in result.dtypes}
    if actual_types != expected_types:
        return f"types {actual_types} expected {expected_types}"
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    for got, want in zip(actual, expected):
        if got != want:
            return f"got {got!r} expected {want!r}"
    return None
