"""Small hand-made inputs."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def users(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows of (id, created_at[, age, gender, state, country])."""
    defaults = (30, "F", "BRAZIL", "United States")
    full = [(row[0], *row[2:], *defaults[len(row) - 2 :], row[1]) for row in rows]
    return spark.createDataFrame(full, schemas.RAW_USERS)


def orders(spark: SparkSession, *rows: tuple) -> DataFrame:
    """Rows of (order_id, user_id, status, created_at, num_of_item)."""
    return spark.createDataFrame(list(rows), schemas.RAW_ORDERS)


def scored(spark: SparkSession, pairs: list[tuple[int, float]]) -> DataFrame:
    rows = [(i, int(y), float(score)) for i, (y, score) in enumerate(pairs)]
    return spark.createDataFrame(rows, schemas.SCORED)


def values(df: DataFrame, *columns: str) -> list[tuple]:
    return [tuple(row) for row in df.select(*columns).collect()]


def one(spark: SparkSession, **columns):
    """Evaluate column expressions over a single row."""
    return spark.range(1).select(*(c.alias(name) for name, c in columns.items())).first()


def assert_equal(left: DataFrame, right: DataFrame) -> None:
    """Same columns, types and rows, duplicates counted, in any order."""
    assert dict(left.dtypes) == dict(right.dtypes)
    names = sorted(left.columns)
    missing = left.select(*names).exceptAll(right.select(*names)).count()
    extra = right.select(*names).exceptAll(left.select(*names)).count()
    assert (missing, extra) == (0, 0)


def skewed_orders(spark: SparkSession, rows: int = 6000, hot_user: int = 7) -> DataFrame:
    """Orders of which a third belong to one user and the rest to a hundred others."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return spark.range(rows).select(
        F.col("id").alias("order_id"),
        F.when(F.col("id") % 3 == 0, hot_user).otherwise(F.col("id") % 101).alias("user_id"),
        F.element_at(
            F.array(*map(F.lit, ("Complete", "Cancelled", "Returned", "Shipped"))),
            (F.col("id") % 4 + 1).cast("int"),
        ).alias("status"),
        (start + F.make_dt_interval(F.lit(0), (F.col("id") % 1000).cast("int"))).alias(
            "created_at"
        ),
        (F.col("id") % 5).alias("num_of_item"),
    )


def many_users(spark: SparkSession, count: int = 90) -> DataFrame:
    start = F.lit("2020-01-10 12:30:00").cast("timestamp_ntz")
    return spark.range(count).select(
        "id",
        (F.col("id") % 60 + 18).cast("int").alias("age"),
        F.when(F.col("id") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.concat(F.lit("S"), (F.col("id") % 4).cast("string")).alias("state"),
        F.when(F.col("id") % 5 < 4, "United States").otherwise("Other").alias("country"),
        start.alias("created_at"),
    )
