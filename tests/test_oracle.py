"""Every query that SQL can express, against an independent engine."""

from __future__ import annotations

import os
import re

import pytest

from tests.compare import assert_same, duck
from tests.conftest import FOLDER
import __spark_entry__ as contract

ORACLE_FOLDER = os.environ.get("ORACLE_SF_DIR", FOLDER)
TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "TIMESTAMP": "timestamp_ntz",
    "DATE": "date",
    "BOOLEAN": "boolean",
}
MAY_BE_EMPTY = {"rate_by_state_min_sample"}


@pytest.fixture(scope="module")
def connection():
    return duck(ORACLE_FOLDER)


# The queries of the training-data operators have their own tests.
NAMES = [name for name in contract.oracle_sql() if not re.match(r"op\d+_|pipeline$", name)]


@pytest.mark.parametrize("name", NAMES)
def test_same_result(spark, connection, name):
    sql = contract.oracle_sql()[name]
    df = contract.queries()[name](spark, ORACLE_FOLDER)
    rows = assert_same(df, connection, sql)
    assert rows > 0 or name in MAY_BE_EMPTY
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    assert {row[0]: TYPES[row[1]] for row in described} == dict(df.dtypes)


def test_every_statement_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    unchecked = set(contract.queries()) - set(contract.oracle_sql())
    unchecked = {name for name in unchecked if not re.match(r"op\d+_|pipeline$", name)}
    assert unchecked == {"rf_scores", "rf_metrics", "rf_report", "batch_scoring"}


def test_entry(spark):
    bands = [row["faixa_tempo_conta"] for row in contract.entry(spark).collect()]
    assert bands == sorted(bands) and len(bands) == 5
