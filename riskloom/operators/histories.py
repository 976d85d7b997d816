"""Order histories per customer and month: partial results that add up to a customer's whole history.

Counts, sums and the last date of a month do not change when other months do. So a month that is loaded or
corrected replaces its own rows, and the whole history of a customer is the sum over one small row per month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.operators.refine import history_measures

MONTH = "mes"


def month_of(column: str):
    """The first day of the month; unknown for an order without a time."""
    return F.trunc(F.to_date(column), "month")


def by_user_and_month(raw_orders: DataFrame) -> DataFrame:
    """One row per customer and month: what :func:`rolled_up` needs of the raw orders."""
    valued = raw_orders.withColumns(
        {"total_order_value": C.order_value(F.col("num_of_item")), MONTH: month_of("created_at")}
    )
    return valued.groupBy("user_id", MONTH).agg(
        *history_measures(),
        F.sum("total_order_value").alias("value"),
        F.count("total_order_value").alias("valued_orders"),
    )


def rolled_up(months: DataFrame) -> DataFrame:
    """Order history and spending per user, as from all raw orders at once.

    Sums are exact in any order: order values are multiples of half a unit.
    """
    total = lambda name: F.sum(name).alias(name)
    value = F.coalesce(F.sum("value"), F.lit(0.0))
    return months.groupBy("user_id").agg(
        total("total_orders"),
        total("total_cancelled_orders"),
        total("total_returned_orders"),
        total("total_items_purchased"),
        F.max("last_order_date").alias("last_order_date"),
        value.alias("customer_lifetime_value"),
        F.try_divide(F.sum("value"), F.sum("valued_orders")).alias("customer_ticket_medio"),
        F.sum("total_orders").alias("total_orders_calculated"),
    )
