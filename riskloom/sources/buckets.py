"""Orders and customers stored in the same buckets by user, so that joining them moves neither.

A bucket is read by one task, so the orders of a customer with very many must not lie in one. Customers with more
than one in MOST_HOT of all orders, of which there are fewer than MOST_HOT, have theirs stored apart, in files of
any size, and are broadcast to them.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import durable
from riskloom.sources import files

# Customers whose orders may be stored apart: the bound of what is broadcast.
MOST_HOT = 10_000


class Orders(NamedTuple):
    """Stored orders: in buckets by user, and those of the customers with very many."""

    bucketed: DataFrame
    hot: DataFrame
    hot_users: DataFrame  # (user_id), fewer than MOST_HOT


def _store(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    spark = df.sparkSession
    laid_out = df.repartition(buckets, "user_id")
    writer = laid_out.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(table)
    return spark.table(table)


def store_customers(customers: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    return _store(customers, table, path, buckets)


def store_orders(
    orders: DataFrame, table: str, path: str, buckets: int, most_hot: int = MOST_HOT
) -> Orders:
    """Store orders in ``buckets`` under ``path``; the table ``table`` has all but those of hot customers."""
    spark = orders.sparkSession
    counts = orders.where("user_id IS NOT NULL").groupBy("user_id").agg(F.count("*").alias("n"))
    counts = durable(counts)
    total = counts.agg(F.sum("n").alias("total")).select("total").scalar()
    # More than one in most_hot of all rows: fewer than most_hot customers.
    hot = counts.where(F.col("n") * most_hot > total).select("user_id")
    hot.coalesce(1).write.mode("overwrite").parquet(f"{path}/hot_users")
    users = F.broadcast(spark.read.schema("user_id bigint").parquet(f"{path}/hot_users"))
    rest = orders.join(users, "user_id", "left_anti").select(*orders.columns)
    cold = _store(rest, table, f"{path}/bucketed", buckets)
    apart = orders.join(users, "user_id", "left_semi").select(*orders.columns)
    files.write_parquet(apart, f"{path}/hot")
    return _beside(cold, path)


def load_orders(spark: SparkSession, table: str, path: str) -> Orders:
    return _beside(spark.table(table), path)


def _beside(bucketed: DataFrame, path: str) -> Orders:
    read = bucketed.sparkSession.read
    users = read.schema("user_id bigint").parquet(f"{path}/hot_users")
    return Orders(bucketed, read.schema(bucketed.schema).parquet(f"{path}/hot"), users)


def with_customers(orders: Orders, customers: DataFrame, how: str = "inner") -> DataFrame:
    """Orders beside their customer's columns; ``customers`` is stored in the same number of buckets.

    Neither side moves: buckets meet buckets, and hot orders stay where they are.
    """
    met = orders.bucketed.join(customers.hint("merge"), "user_id", how)
    return met.unionByName(orders.hot.join(_hot_customers(orders, customers), "user_id", how))


def known_customers_only(orders: Orders, customers: DataFrame) -> DataFrame:
    """The orders of stored customers, without moving any."""
    names, ids = orders.bucketed.columns, customers.select("user_id")
    cold = orders.bucketed.join(ids.hint("merge"), "user_id", "left_semi").select(*names)
    hot = orders.hot.join(_hot_customers(orders, ids), "user_id", "left_semi").select(*names)
    return cold.union(hot)


def _hot_customers(orders: Orders, customers: DataFrame) -> DataFrame:
    # Safe to broadcast: fewer than MOST_HOT ids, and as many customers.
    return F.broadcast(customers.join(F.broadcast(orders.hot_users), "user_id", "left_semi"))


def drop(spark: SparkSession, *tables: str) -> None:
    """Forget the tables; their files stay until they are removed."""
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
