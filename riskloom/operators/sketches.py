"""Distinct customers per segment and period from sketches that can be united.

An exact count of distinct customers has to see all orders again for every period. A sketch per segment and month
is a few kilobytes, and the sketches of any months unite to that of the period, so a year is twelve
rows a segment. Counts are estimates with a relative standard error of about 1.04 / sqrt(2 ** bits); the exact
count of :func:`exact_clients` is the default wherever it is affordable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registers of a sketch as a power of two: a standard error of about 0.8 %.
BITS = 14


def monthly_sketches(
    orders: DataFrame, segments: Sequence[str], time: str = "order_timestamp", bits: int = BITS
) -> DataFrame:
    """(segments, mes, clients, n): a sketch of the customers of each segment and month, and the orders."""
    month = F.trunc(F.to_date(time), "month").alias("mes")
    return orders.groupBy(*segments, month).agg(
        F.hll_sketch_agg("user_id", bits).alias("clients"), F.count("*").alias("n")
    )


def clients_in(sketches: DataFrame, segments: Sequence[str], months: Column | None = None) -> DataFrame:
    """(segments, clients, n): estimated customers and the orders over the months that meet the condition."""
    some = sketches if months is None else sketches.where(months)
    united = F.hll_sketch_estimate(F.hll_union_agg("clients"))
    return some.groupBy(*segments).agg(united.alias("clients"), F.sum("n").alias("n"))


def exact_clients(
    orders: DataFrame, segments: Sequence[str], months: Column | None = None, time: str = "order_timestamp"
) -> DataFrame:
    """The same with exact counts, from all orders of the period."""
    dated = orders.withColumn("mes", F.trunc(F.to_date(time), "month"))
    some = dated if months is None else dated.where(months)
    return some.groupBy(*segments).agg(
        F.count_distinct("user_id").alias("clients"), F.count("*").alias("n")
    )
