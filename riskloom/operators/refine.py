"""Cleaned users and orders, and the bad-payer label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import labels as L
from riskloom.functions.columns import naive_utc  # noqa: F401  (part of refining raw tables)

REFINED_USERS = [
    "user_id",
    "age",
    "gender",
    "state",
    "account_created_at",
    "total_orders",
    "total_cancelled_orders",
    "total_returned_orders",
    "total_items_purchased",
    "last_order_date",
    "is_bad_payer",
]


def user_demographics(raw_users: DataFrame, country: str = L.COUNTRY) -> DataFrame:
    return raw_users.where(F.col("country") == country).select(
        F.col("id").alias("user_id"),
        "age",
        "gender",
        "state",
        F.col("created_at").alias("account_created_at"),
    )


def history_measures() -> list[Column]:
    """What a customer's raw orders add up to."""
    return [
        F.count("order_id").alias("total_orders"),
        F.count_if(F.col("status") == L.CANCELLED).alias("total_cancelled_orders"),
        F.count_if(F.col("status") == L.RETURNED).alias("total_returned_orders"),
        F.sum("num_of_item").cast("double").alias("total_items_purchased"),
        F.max("created_at").alias("last_order_date"),
    ]


def user_order_aggregates(raw_orders: DataFrame) -> DataFrame:
    """Order history per user; partial sums are taken before the shuffle."""
    return raw_orders.groupBy("user_id").agg(*history_measures())


def with_history(demographics: DataFrame, history: DataFrame) -> DataFrame:
    """Attach the order history to every user and label bad payers.

    Users without orders get zeros, no last order date and label 0.
    """
    orders, cancelled, returned, items = (
        F.coalesce(name, F.lit(0))
        for name in (
            "total_orders",
            "total_cancelled_orders",
            "total_returned_orders",
            "total_items_purchased",
        )
    )
    return demographics.join(history, "user_id", "left").withColumns(
        {
            "total_orders": orders,
            "total_cancelled_orders": cancelled,
            "total_returned_orders": returned,
            "total_items_purchased": items,
            "is_bad_payer": C.bad_payer(orders, cancelled, returned),
        }
    )


def refined_users(raw_users: DataFrame, raw_orders: DataFrame) -> DataFrame:
    customers = with_history(user_demographics(raw_users), user_order_aggregates(raw_orders))
    return customers.select(*REFINED_USERS)


def order_facts(raw_orders: DataFrame) -> DataFrame:
    """Columns of a refined order, for all orders: a pure projection."""
    hour = F.hour("created_at")
    return raw_orders.select(
        "order_id",
        "user_id",
        "status",
        F.col("created_at").alias("order_timestamp"),
        hour.alias("order_hour"),
        C.hour_label(hour).alias("order_hour_formatted"),
        C.shift(hour).alias("turno_pedido"),
        C.flag(F.col("status") == L.CANCELLED).alias("is_cancelled"),
        C.flag(F.col("status") == L.RETURNED).alias("is_returned"),
        F.col("num_of_item").alias("total_items_purchased"),
        C.order_value(F.col("num_of_item")).alias("total_order_value"),
    )


def refined_orders(raw_orders: DataFrame, users: DataFrame) -> DataFrame:
    """Orders of the given users (any frame with a unique ``user_id``).

    A user with very many orders is split by the engine's skew join.
    """
    facts = order_facts(raw_orders)
    return facts.join(users.select("user_id"), "user_id", "left_semi").select(*facts.columns)
