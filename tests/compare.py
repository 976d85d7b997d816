"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import duckdb

TABLES = "region nation customer supplier part orders lineitem events".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')"
        )
    return connection


def sort_key(row: tuple) -> tuple:
    return tuple((value is None, 0 if value is None else value) for value in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(row[i] for i in order) for row in rows), key=sort_key)


def assert_same(df, connection: duckdb.DuckDBPyConnection, sql: str) -> int:
    cursor = connection.execute(sql)
    expected_columns = [column[0] for column in cursor.description]
    expected = rows_of(expected_columns, cursor.fetchall())
    actual = rows_of(df.columns, [tuple(row) for row in df.collect()])
    assert sorted(df.columns) == sorted(expected_columns)
    assert len(actual) == len(expected)
    for mine, theirs in zip(actual, expected):
        assert mine == theirs
    return len(actual)
