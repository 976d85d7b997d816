"""Risk by hour and shift, all read off one profile of at most 25 rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import columns as C
from riskloom.functions import labels as L
from riskloom.operators.refine import order_facts, user_demographics


def hourly_profile(orders: DataFrame) -> DataFrame:
    """Orders, value and their bad-payer part per hour, from an orders table with labels."""
    bad = F.col("is_bad_payer") == 1
    profile = orders.groupBy("order_hour").agg(
        F.count("*").alias("orders"),
        F.count_if(bad).alias("bad_orders"),
        F.sum("total_order_value").alias("value"),
        F.sum(F.when(bad, F.col("total_order_value"))).alias("bad_value"),
    )
    return _with_labels(profile)


def _with_labels(profile: DataFrame) -> DataFrame:
    """Label and shift follow from the hour, so they stay out of the shuffles."""
    hour = F.col("order_hour")
    return profile.select(
        hour,
        C.hour_label(hour).alias("order_hour_formatted"),
        C.shift(hour).alias("turno_pedido"),
        "orders",
        "bad_orders",
        "value",
        "bad_value",
    )


def hourly_profile_from_raw(raw_users: DataFrame, raw_orders: DataFrame) -> DataFrame:
    """The same profile straight from raw data, in one pass over the orders.

    Orders shrink to one row per user and hour before anything is shuffled by user, so even a
    user with a third of all orders brings at most 25 rows to the window and the join.
    """
    per_user_hour = (
        order_facts(raw_orders)
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id", "order_hour")
        .agg(
            F.count("*").alias("orders"),
            F.count("order_id").alias("known"),
            F.sum("is_cancelled").alias("cancelled"),
            F.sum("is_returned").alias("returned"),
            F.sum("total_order_value").alias("value"),
        )
    )
    of_user = Window.partitionBy("user_id")
    totals = [F.sum(name).over(of_user) for name in ("known", "cancelled", "returned")]
    labelled = per_user_hour.withColumn("is_bad_payer", C.bad_payer(*totals)).join(
        user_demographics(raw_users).select("user_id"), "user_id", "left_semi"
    )
    bad = F.col("is_bad_payer") == 1
    profile = labelled.groupBy("order_hour").agg(
        F.sum("orders").alias("orders"),
        F.sum(F.when(bad, F.col("orders")).otherwise(0)).alias("bad_orders"),
        F.sum("value").alias("value"),
        F.sum(F.when(bad, F.col("value"))).alias("bad_value"),
    )
    return _with_labels(profile)


def _share(part: str, whole: str) -> Column:
    return F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double"))


def detractors_by_shift(profile: DataFrame) -> DataFrame:
    """Orders of bad payers per shift; a shift without any has no row."""
    per_shift = profile.groupBy("turno_pedido").agg(F.sum("bad_orders").alias("detratores"))
    return per_shift.where(F.col("detratores") > 0)


def shift_gap(profile: DataFrame) -> DataFrame:
    """Gap between the shifts as a share of all detractors; no row unless both have some."""

    def of_shift(name: str) -> Column:
        orders = F.sum(F.when(F.col("turno_pedido") == name, F.col("bad_orders")))
        return F.coalesce(orders, F.lit(0))

    shifts = profile.agg(
        of_shift(L.DAY_SHIFT).alias("dia"), of_shift(L.NIGHT_SHIFT).alias("noite")
    )
    gap = F.abs(F.col("dia") - F.col("noite")) / (F.col("dia") + F.col("noite"))
    return shifts.where((F.col("dia") > 0) & (F.col("noite") > 0)).select(gap.alias("diff_pct"))


def rate_by_hour(profile: DataFrame) -> DataFrame:
    return (
        profile.where(F.col("order_hour").isNotNull())
        .select(
            "order_hour_formatted",
            _share("bad_orders", "orders").alias("taxa"),
            F.col("order_hour").alias("hora"),
            F.col("orders").alias("n"),
        )
        .orderBy("hora")
    )


def hours_above_average(profile: DataFrame) -> DataFrame:
    """Hours whose rate exceeds that of all orders together."""
    # One unpartitioned window over the profile's 25 rows.
    everything = Window.partitionBy(F.lit(0))
    overall = F.sum("bad_orders").over(everything) / F.sum("orders").over(everything)
    return (
        profile.withColumn("taxa_geral", overall)
        .withColumn("taxa", _share("bad_orders", "orders"))
        .where(F.col("order_hour").isNotNull() & (F.col("taxa") > F.col("taxa_geral")))
        .select("order_hour_formatted", F.col("order_hour").alias("hora"), "taxa", "taxa_geral")
        .orderBy("hora")
    )


def value_at_risk_by_hour(profile: DataFrame) -> DataFrame:
    """Share of each hour's order value that belongs to bad payers."""
    risk = F.try_divide(F.coalesce("bad_value", F.lit(0.0)), F.col("value"))
    return (
        profile.where(F.col("order_hour").isNotNull())
        .select(
            "order_hour_formatted",
            F.col("order_hour").alias("hora"),
            risk.alias("valor_em_risco"),
            F.col("orders").alias("n"),
        )
        .orderBy("hora")
    )


def peak_value_at_risk_hour(profile: DataFrame) -> DataFrame:
    """The hour with the highest share of value at risk, the earliest of equals."""
    return (
        value_at_risk_by_hour(profile)
        .orderBy(F.desc_nulls_last("valor_em_risco"), "hora")
        .limit(1)
    )


def with_shift_hour_index(orders: DataFrame) -> DataFrame:
    return orders.withColumn("shift_hour_index", C.shift_hour_index(F.col("order_hour")))
