"""Refinement and feature tables on hand-made and supplied data."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, hourly, refine, segments
from riskloom.plans.queries import Tables
from tests.frames import assert_equal, at, many_users, orders, skewed_orders, users, values


def build(spark, raw_users, raw_orders):
    refined = refine.refined_users(raw_users, raw_orders)
    kept = refine.refined_orders(raw_orders, refined)
    return refined, kept, features.behavior_features(kept)


@pytest.mark.parametrize("zone", ["UTC", "America/Sao_Paulo"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "string"])
def test_creation_times_end_up_in_utc(spark, zone, kind):
    text = "2020-07-01 23:30:00.123456" + ("Z" if kind == "timestamp" else "")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.range(1).select(F.lit(text).cast(kind).alias("created_at"))
        naive = refine.naive_utc(df)
        assert naive.dtypes == [("created_at", "timestamp_ntz")]
        assert naive.first().created_at == at("2020-07-01T23:30:00.123456")
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_user_without_orders(spark):
    raw_users = users(spark, (1, at("2020-01-01")), (2, at("2020-01-01")))
    raw_orders = orders(spark, (10, 1, "Complete", at("2020-02-01"), 2))
    refined, _, behavior = build(spark, raw_users, raw_orders)
    row = refined.where("user_id = 2").first()
    assert (row.total_orders, row.total_items_purchased, row.last_order_date) == (0, 0.0, None)
    assert row.is_bad_payer == 0
    feature = features.features_modeling(refined, behavior).where("user_id = 2").first()
    assert (feature.customer_lifetime_value, feature.customer_ticket_medio) == (0.0, 0.0)
    assert feature.total_orders_calculated == 0


def test_other_countries_and_unknown_users_are_left_out(spark):
    raw_users = users(
        spark, (1, at("2020-01-01")), (2, at("2020-01-01"), 30, "F", "BRAZIL", "Other")
    )
    raw_orders = orders(
        spark,
        (10, 1, "Complete", at("2020-02-01"), 1),
        (11, 2, "Complete", at("2020-02-01"), 1),
        (12, 3, "Complete", at("2020-02-01"), 1),
        (13, None, "Complete", at("2020-02-01"), 1),
    )
    refined, kept, _ = build(spark, raw_users, raw_orders)
    assert values(refined, "user_id") == [(1,)]
    assert values(kept, "order_id") == [(10,)]


def test_mean_ticket_rounds_to_even(spark):
    # 45.5 * (3 + 4) / 4 orders = 79.625
    raw_orders = orders(
        spark, *((i, 1, "Complete", at("2020-02-01"), n) for i, n in enumerate((3, 4, 0, 0)))
    )
    table = features.features_from_raw(users(spark, (1, at("2020-01-01"))), raw_orders)
    row = table.first()
    assert (row.customer_lifetime_value, row.customer_ticket_medio) == (318.5, 79.62)


def test_missing_item_counts_add_up_to_zero(spark):
    raw_orders = orders(spark, (10, 1, None, at("2020-02-01"), None))
    raw_users = users(spark, (1, at("2020-01-01")))
    refined, kept, behavior = build(spark, raw_users, raw_orders)
    row = kept.first()
    assert (row.is_cancelled, row.is_returned, row.total_order_value) == (0, 0, None)
    feature = features.features_modeling(refined, behavior).first()
    assert (feature.customer_lifetime_value, feature.customer_ticket_medio) == (0.0, 0.0)


def test_orders_of_unknown_users_fall_into_the_last_band(spark):
    raw_users = users(spark, (1, at("2020-01-01T10:00:00")))
    raw_orders = orders(
        spark,
        (10, 1, "Complete", at("2020-01-01T09:00:00"), 1),
        (11, 1, "Complete", at("2020-01-01T11:00:00"), 1),
        (12, 9, "Complete", at("2020-01-01T11:00:00"), 1),
        (13, None, "Complete", at("2020-01-01T11:00:00"), 1),
    )
    refined = refine.refined_users(raw_users, raw_orders)
    table = features.orders_modeling(refine.order_facts(raw_orders), refined).orderBy("order_id")
    assert values(
        table, "order_id", "is_bad_payer", "dias_conta_ate_compra", "faixa_tempo_conta"
    ) == [
        (10, 0, -1, "0. Inconsistente"),
        (11, 0, 0, "1. < 30 dias"),
        (12, 0, None, "4. +365 dias"),
        (13, 0, None, "4. +365 dias"),
    ]


def test_one_pass_equals_step_by_step(spark):
    raw_users, raw_orders = many_users(spark), skewed_orders(spark)
    refined, kept, behavior = build(spark, raw_users, raw_orders)
    assert_equal(
        features.features_from_raw(raw_users, raw_orders),
        features.features_modeling(refined, behavior),
    )
    stepwise = features.orders_modeling(kept, refined)
    fused = features.orders_modeling(refine.order_facts(raw_orders), refined, "inner")
    assert_equal(fused, stepwise)
    assert_equal(
        hourly.hourly_profile_from_raw(raw_users, raw_orders), hourly.hourly_profile(stepwise)
    )
    from_clients = segments.kpis(features.features_from_raw(raw_users, raw_orders))
    from_orders = segments.order_kpis(stepwise)
    assert_equal(from_clients.select(*from_orders.columns), from_orders)


def test_invariants_of_the_supplied_data(spark, folder):
    t = Tables(spark, folder)
    refined, kept = t.users.cache(), t.refined_orders.cache()
    behavior = features.behavior_features(kept)
    both = refined.join(behavior.withColumnsRenamed(
        {"total_cancelled_orders": "cancelled", "total_returned_orders": "returned"}
    ), "user_id", "left")
    different = both.where(
        (F.col("total_orders") != F.coalesce("total_orders_calculated", F.lit(0)))
        | (F.col("total_cancelled_orders") != F.coalesce("cancelled", F.lit(0)))
        | (F.col("total_returned_orders") != F.coalesce("returned", F.lit(0)))
    )
    assert different.count() == 0

    table = t.orders().cache()
    assert table.count() == kept.count()
    assert kept.select("order_id").distinct().count() == kept.count()
    assert refined.select("user_id").distinct().count() == refined.count()
    assert t.features.count() == refined.count()
    revenue = table.agg(F.sum("total_order_value")).first()[0]
    assert revenue == t.features.agg(F.sum("customer_lifetime_value")).first()[0]
    assert table.where(F.col("faixa_tempo_conta").isNull()).count() == 0
    assert table.where(~F.col("is_bad_payer").isin(0, 1)).count() == 0
    assert refined.where((F.col("total_orders") < 2) & (F.col("is_bad_payer") == 1)).count() == 0
    profile = t.profile.cache()
    assert profile.count() <= 24
    assert profile.agg(F.sum("orders")).first()[0] == table.count()
    for frame in (refined, kept, table, profile):
        frame.unpersist()
