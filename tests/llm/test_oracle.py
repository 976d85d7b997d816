"""The queries that SQL can express, against an independent engine, over whole tables."""

from __future__ import annotations

import duckdb
import pytest

from riskloom.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import assert_same


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_same_result(spark, folder, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    assert assert_same(QUERIES[name](spark, folder), connection, ORACLE_SQL[name]) > 0
