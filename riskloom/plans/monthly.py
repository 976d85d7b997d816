"""Loading single months: the stored tables follow without a rebuild of all that was there before."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.operators import features, histories, refine
from riskloom.operators.histories import MONTH
from riskloom.session import durable, temporary
from riskloom.sources import files

Month = date | None  # the first day; None for orders without a time


def load_months(
    raw_users: DataFrame, raw_orders: DataFrame, path: str, months: Iterable[Month] | None = None
) -> dict[str, list[Month]]:
    """Load or correct the given months, or all; the tables are then as if built from all raw tables.

    ``raw_orders`` may be the whole source: only the months that need it are read. Beside the tables of
    :func:`riskloom.plans.jobs.build_tables` there is ``user_months``, a row per customer and month, from which
    the customers' histories are rolled up. Folders of other months are written only where a customer's
    label or account changed, or a customer came or went; the two tables of customers are written anew. The
    months that were written are returned by table.

    Customers are written last. A load that was cut off is repeated by the same call, and a repeated
    load leaves the same rows.
    """
    spark = raw_users.sparkSession
    users, orders = refine.naive_utc(raw_users), refine.naive_utc(raw_orders)
    with temporary(spark):
        known = _stored(spark, path, "refined_users", schemas.REFINED_USERS)
        loaded = None if months is None else _sorted(set(months))
        # Raw orders may be costly to read: each month is read once, and what is read is kept for the three tables.
        months_read = durable(in_months(orders, "created_at", loaded))
        counted = histories.by_user_and_month(months_read)
        files.replace_months(counted, f"{path}/user_months", MONTH, loaded)
        stored_months = files.read_parquet(spark, f"{path}/user_months", schemas.USER_MONTHS)
        history = histories.rolled_up(stored_months)
        customers = durable(refine.with_history(refine.user_demographics(users), history))
        refined = customers.select(*refine.REFINED_USERS)

        changed = durable(_changed(known, refined))
        other = stored_months.join(changed, "user_id").groupBy(MONTH).agg(F.max("came_or_went").alias("all"))
        touched = other.collect()  # one row per month
        relabelled = _united(loaded, [row[MONTH] for row in touched])
        resettled = _united(loaded, [row[MONTH] for row in touched if row["all"]])

        if relabelled is not None and (more := [month for month in relabelled if month not in set(loaded)]):
            months_read = months_read.union(durable(in_months(orders, "created_at", more)))
        rows = refine.refined_orders(in_months(months_read, "created_at", resettled), refined)
        files.replace_months(_dated(rows), f"{path}/refined_orders", MONTH, resettled)
        facts = refine.order_facts(months_read)
        joined = features.orders_modeling(facts, refined, "inner")
        files.replace_months(_dated(joined), f"{path}/orders_modeling", MONTH, relabelled)

        files.write_parquet(features.finish_features(customers), f"{path}/features_modeling")
        files.write_parquet(refined, f"{path}/refined_users")
        return {
            "user_months": loaded, "refined_orders": resettled, "orders_modeling": relabelled,
        }


def _sorted(months: Iterable[Month]) -> list[Month]:
    return sorted(months, key=lambda month: (month is not None, month or date.min))


def _united(loaded: list[Month] | None, more: list[Month]) -> list[Month] | None:
    return None if loaded is None else _sorted({*loaded, *more})


def _dated(orders: DataFrame) -> DataFrame:
    return orders.withColumn(MONTH, histories.month_of("order_timestamp"))


def _stored(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A stored table as it is now, or an empty one."""
    if not files.exists(spark, f"{path}/{name}"):
        return spark.createDataFrame([], schema)
    return durable(files.read_parquet(spark, f"{path}/{name}", schema))


def _changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, came_or_went) of the customers whose orders look different now."""
    ends = [F.struct("is_bad_payer", "account_created_at").alias(name) for name in ("old", "new")]
    met = before.select("user_id", ends[0]).join(after.select("user_id", ends[1]), "user_id", "full")
    came_or_went = (F.col("old").isNull() | F.col("new").isNull()).cast("int")
    return met.where(~F.col("old").eqNullSafe(F.col("new"))).select("user_id", came_or_went.alias("came_or_went"))


def in_months(df: DataFrame, column: str, months: list[Month] | None) -> DataFrame:
    """The rows of the given months, by ranges that reach the scan; all where ``months`` is None."""
    if months is None:
        return df
    return df.where(_within(column, months))


def _within(column: str, months: list[Month]) -> Column:
    found = F.lit(False)
    ranges: list[list[date]] = []
    for month in _sorted(months):
        if month is None:
            found = found | F.col(column).isNull()
        elif ranges and ranges[-1][1] == month:
            ranges[-1][1] = _next(month)
        else:
            ranges.append([month, _next(month)])
    for start, end in ranges:
        low, high = (F.lit(day.isoformat()).cast("timestamp_ntz") for day in (start, end))
        found = found | ((F.col(column) >= low) & (F.col(column) < high))
    return found


def _next(month: date) -> date:
    return date(month.year + month.month // 12, month.month % 12 + 1, 1)
