from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.operators.features import features_from_raw
from riskloom.sources import files, testdata
from tests.frames import assert_equal, at, orders, users


def test_csv_keeps_microseconds_and_nulls(spark, tmp_path):
    table = users(spark, (1, at("2020-01-01T10:00:00.123456")), (2, None, None, None, None))
    path = str(tmp_path / "users")
    files.write_csv(table, path)
    assert_equal(files.read_csv(spark, path, schemas.RAW_USERS), table)


def test_csv_empty_strings_come_back_as_null(spark, tmp_path):
    path = str(tmp_path / "users")
    files.write_csv(users(spark, (1, at("2020-01-01"), 30, "")), path)
    assert files.read_csv(spark, path, schemas.RAW_USERS).first().gender is None


def test_csv_keeps_blanks_quotes_and_line_breaks(spark, tmp_path):
    texts = [" lead", "trail ", " both ", 'say "x", y', "a\nb", "a\r\nb", "\\", "back\\slash,"]
    table = users(spark, *((i, at("2020-01-01"), 30, text) for i, text in enumerate(texts)))
    path = str(tmp_path / "users")
    files.write_csv(table, path)
    assert_equal(files.read_csv(spark, path, schemas.RAW_USERS, multi_line=True), table)


def test_csv_times_of_any_precision_and_zone(spark, tmp_path):
    path = tmp_path / "users.csv"
    texts = {
        "2020-01-01 10:00:00": "2020-01-01T10:00:00",
        "2020-01-01 10:00:00.5": "2020-01-01T10:00:00.500000",
        "2020-01-01 10:00:00.123456": "2020-01-01T10:00:00.123456",
        "2020-01-01 10:00:00+00:00": "2020-01-01T10:00:00",
        "2020-01-01T10:00:00-03:00": "2020-01-01T13:00:00",
        "2020-01-01 10:00:00.25 UTC": "2020-01-01T10:00:00.250000",
        "2020-01-01": "2020-01-01T00:00:00",
    }
    lines = [f"{i},30,F,A,B,{text}" for i, text in enumerate(texts)]
    path.write_text("\n".join(["id,age,gender,state,country,created_at", *lines, "99,30,F,A,B,"]) + "\n")
    found = files.read_csv(spark, str(path), schemas.RAW_USERS).orderBy("id").collect()
    assert [row.created_at for row in found] == [*map(at, texts.values()), None]


def test_bad_csv_time_fails(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text("id,age,gender,state,country,created_at\n1,3,F,A,B,yesterday\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(path), schemas.RAW_USERS).collect()


def test_csv_overwrites(spark, tmp_path):
    path = str(tmp_path / "users")
    for user in (1, 2):
        files.write_csv(users(spark, (user, at("2020-01-01"))), path)
    assert [row.id for row in files.read_csv(spark, path, schemas.RAW_USERS).collect()] == [2]


def test_bad_csv_fails(spark, tmp_path):
    path = tmp_path / "users.csv"
    path.write_text("id,age,gender,state,country,created_at\n1,old,F,A,B,\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_csv(spark, str(path), schemas.RAW_USERS).collect()


def test_missing_table_is_named(spark, tmp_path):
    with pytest.raises(AnalysisException, match="orders.parquet"):
        testdata.raw_orders(spark, str(tmp_path)).count()


def test_months_are_folders(spark, tmp_path):
    table = orders(
        spark,
        (1, 1, "Complete", at("2020-01-31T23:59:59"), 1),
        (2, 1, "Complete", at("2020-02-01T00:00:00"), 1),
        (3, 1, "Complete", at("2020-02-28T00:00:00"), 1),
    )
    path = tmp_path / "orders"
    files.write_parquet_by_month(table, str(path), "created_at")
    folders = sorted(p.name for p in path.iterdir() if p.name.startswith("mes="))
    assert folders == ["mes=2020-01-01", "mes=2020-02-01"]
    back = files.read_parquet(spark, str(path), schemas.RAW_ORDERS)
    assert_equal(back.drop("mes"), table)
    assert back.where(F.col("mes") == "2020-02-01").count() == 2


def test_feature_table_survives_csv(spark, tmp_path):
    raw_users = users(spark, (1, at("2020-01-01T01:02:03")), (2, at("2020-01-01")))
    raw_orders = orders(spark, (10, 1, "Returned", at("2020-02-01"), 3))
    table = features_from_raw(raw_users, raw_orders)
    assert table.schema.simpleString() == f"struct<{schemas.FEATURES_MODELING}>".replace(
        ", ", ","
    ).replace(" ", ":")
    path = str(tmp_path / "features")
    files.write_csv(table, path)
    assert_equal(files.read_csv(spark, path, schemas.FEATURES_MODELING), table)
