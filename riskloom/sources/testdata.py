"""Raw users and orders, mapped from the supplied test tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.sources.files import read_parquet


def paths(folder: str) -> list[str]:
    """Where the tables lie that raw users and orders are made of."""
    return [f"{folder}/{name}.parquet" for name in schemas.TEST_TABLES]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{folder}/{name}.parquet", schemas.TEST_TABLES[name])


def raw_users(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    # Safe to broadcast: 25 nations at every scale.
    nation = F.broadcast(table(spark, folder, "nation"))
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr(
        "c_custkey AS id",
        "CAST(18 + c_custkey % 60 AS int) AS age",
        "CASE WHEN (c_custkey * 13) % 7 < 4 THEN 'F' ELSE 'M' END AS gender",
        "n_name AS state",
        "CASE WHEN n_regionkey < 3 THEN 'United States' ELSE 'Other' END AS country",
        "TIMESTAMP_NTZ '1995-01-01' + INTERVAL 1 DAY * ((c_custkey * 37) % 400)"
        " + INTERVAL 1 HOUR * (c_custkey % 24) AS created_at",
    )


# One row of ``orders`` as a raw order; batch and streaming reads share it.
ORDER_COLUMNS = (
    "o_orderkey AS order_id",
    "CASE WHEN o_orderkey % 10 <= o_custkey % 10 THEN o_custkey"
    " ELSE o_custkey - o_custkey % 10 + 9 END AS user_id",
    "CASE WHEN o_orderpriority = '1-URGENT' THEN 'Cancelled'"
    " WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'Returned'"
    " WHEN o_orderstatus = 'F' THEN 'Complete'"
    " WHEN o_orderstatus = 'O' THEN 'Shipped'"
    " ELSE 'Processing' END AS status",
    "o_orderdate + INTERVAL 1 HOUR * ((o_orderkey * 7) % 24)"
    " + INTERVAL 1 MINUTE * (o_orderkey % 60) AS created_at",
)


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    items = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(F.count("*").alias("items"))
    )
    return orders.join(items, "o_orderkey", "left").selectExpr(
        *ORDER_COLUMNS, "coalesce(items, 0L) AS num_of_item"
    )


def order_stream(spark: SparkSession, folder: str, batch_bytes: int | None = None) -> DataFrame:
    """The order table read as a stream of files.

    ``batch_bytes``: new bytes a micro-batch may take, so that a backlog is worked off in steps; by
    default a batch takes all there is. The pattern, which matches that one name, lets the table
    be a single file: a stream does not accept a file by its plain name.
    """
    reader = spark.readStream.schema(schemas.TEST_TABLES["orders"])
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    return reader.parquet(f"{folder}/orders.parque[t]").selectExpr(*ORDER_COLUMNS)
