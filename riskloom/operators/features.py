"""Per-customer features and the per-order analysis table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators.refine import history_measures, user_demographics, with_history

MONEY = ["customer_lifetime_value", "customer_ticket_medio"]
COUNTS = ["total_cancelled_orders", "total_returned_orders", "total_orders_calculated"]
FEATURE_TABLE = ["user_id", "age", "gender", "state", "account_created_at", "is_bad_payer"]


def value_measures() -> list[Column]:
    return [
        F.coalesce(F.sum("total_order_value"), F.lit(0.0)).alias("customer_lifetime_value"),
        F.avg("total_order_value").alias("customer_ticket_medio"),
    ]


def behavior_features(orders: DataFrame) -> DataFrame:
    """Spending and friction per user; orders without a user are left out."""
    return (
        orders.where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(
            *value_measures(),
            F.coalesce(F.sum("is_cancelled"), F.lit(0)).alias("total_cancelled_orders"),
            F.coalesce(F.sum("is_returned"), F.lit(0)).alias("total_returned_orders"),
            F.count("order_id").alias("total_orders_calculated"),
        )
    )


def features_modeling(users: DataFrame, behavior: DataFrame) -> DataFrame:
    """One row per user, with zeros where a user has no orders."""
    return finish_features(users.select(*FEATURE_TABLE).join(behavior, "user_id", "left"))


def finish_features(customers: DataFrame) -> DataFrame:
    """Fill gaps, round money, and keep the columns of the feature table."""
    money = [C.round_cents(F.coalesce(name, F.lit(0.0))).alias(name) for name in MONEY]
    counts = [F.coalesce(name, F.lit(0)).alias(name) for name in COUNTS]
    return customers.select(*FEATURE_TABLE, *money, *counts)


def customers_from_raw(raw_users: DataFrame, raw_orders: DataFrame) -> DataFrame:
    """Refined users and their unrounded behavior in one frame, straight from raw data.

    Label and behavior come from one pass over the orders and one aggregation by user. The
    orders themselves are never joined: users of other countries drop out after they have shrunk
    to one row each.
    """
    history = (
        raw_orders.withColumn("total_order_value", C.order_value(F.col("num_of_item")))
        .groupBy("user_id")
        .agg(
            *history_measures(),
            *value_measures(),
            F.count("order_id").alias("total_orders_calculated"),
        )
    )
    return with_history(user_demographics(raw_users), history)


def features_from_raw(raw_users: DataFrame, raw_orders: DataFrame) -> DataFrame:
    """The feature table straight from raw data."""
    return finish_features(customers_from_raw(raw_users, raw_orders))


def orders_modeling(
    orders: DataFrame,
    users: DataFrame,
    how: str = "left",
    customer_columns: Sequence[str] = (),
) -> DataFrame:
    """One row per order with the customer's label and the account's age at the order.

    An order of an unknown user keeps label 0 and falls into the last account-age band. With
    ``how="inner"`` such orders are dropped: on unfiltered :func:`order_facts` this equals
    refining the orders first, for one join instead of two. ``customer_columns`` adds further
    columns of the users. A user with very many orders is split by the engine's skew join, if
    ``users`` is a stored table and not an aggregation by user itself.
    """
    customer = users.select("user_id", "is_bad_payer", "account_created_at", *customer_columns)
    return finish_orders(orders.join(customer, "user_id", how), customer_columns)


def finish_orders(joined: DataFrame, customer_columns: Sequence[str] = ()) -> DataFrame:
    """The columns of the analysis table, from orders beside their customer's columns."""
    days = C.elapsed_days(F.col("order_timestamp"), F.col("account_created_at"))
    return joined.withColumn("dias_conta_ate_compra", days).select(
        "order_id",
        "user_id",
        "order_timestamp",
        "order_hour",
        "order_hour_formatted",
        "turno_pedido",
        "is_cancelled",
        "is_returned",
        "total_order_value",
        F.coalesce("is_bad_payer", F.lit(0)).cast("int").alias("is_bad_payer"),
        "account_created_at",
        "dias_conta_ate_compra",
        C.account_age_band(F.col("dias_conta_ate_compra")).alias("faixa_tempo_conta"),
        *customer_columns,
    )


def client_bands(clients: DataFrame) -> DataFrame:
    """Add the age band and the customer-value band."""
    return clients.withColumns(
        {
            "Faixa_Etaria": C.age_band(F.col("age")),
            "Faixa_CLV": C.clv_band(F.col("customer_lifetime_value")),
        }
    )
