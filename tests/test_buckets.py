"""Joins of tables in the same buckets: nothing moves, and hot customers do not sit in one bucket."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import features, refine
from riskloom.sources import buckets
from tests.frames import assert_equal, many_users, skewed_orders

ORDERS, USERS = "bucketed_test_orders", "bucketed_test_users"


@pytest.fixture
def stored(spark, tmp_path):
    """A third of all orders are one customer's."""
    customers = refine.refined_users(many_users(spark), skewed_orders(spark))
    users = buckets.store_customers(customers, USERS, str(tmp_path / "users"), 5)
    facts = refine.order_facts(skewed_orders(spark))
    orders = buckets.store_orders(facts, ORDERS, str(tmp_path / "orders"), 5, most_hot=20)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield orders, users, facts, customers, str(tmp_path / "orders")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    buckets.drop(spark, ORDERS, USERS)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_move_neither_side(stored):
    orders, users, *_ = stored
    users = users.select("user_id", "is_bad_payer", "account_created_at")
    for df in (buckets.with_customers(orders, users), buckets.known_customers_only(orders, users)):
        plan = plan_of(df)
        assert plan.count("SortMergeJoin") == 1 and "Bucketed: true" in plan
        assert "Exchange hashpartitioning" not in plan


def test_results_equal_the_plain_joins(spark, stored):
    orders, users, facts, customers, path = stored
    expected = features.orders_modeling(facts, customers, "inner")
    customer = users.select("user_id", "is_bad_payer", "account_created_at")
    for these in (orders, buckets.load_orders(spark, ORDERS, path)):
        assert_equal(features.finish_orders(buckets.with_customers(these, customer)), expected)
    kept = refine.refined_orders(skewed_orders(spark), customers)
    assert_equal(buckets.known_customers_only(orders, users), kept)


def test_the_hot_customer_is_stored_apart(spark, stored):
    orders, _, facts, *_ = stored
    assert [r["user_id"] for r in orders.hot.select("user_id").distinct().collect()] == [7]
    assert orders.bucketed.where("user_id = 7").count() == 0
    largest = orders.bucketed.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert largest < facts.count() / 4
    assert orders.hot.count() + orders.bucketed.count() == facts.count()


def test_orders_without_a_user_and_empty_tables(spark, tmp_path):
    facts = refine.order_facts(skewed_orders(spark, 60)).withColumn(
        "user_id", F.when(F.col("order_id") % 2 == 0, F.col("user_id"))
    )
    customers = refine.refined_users(many_users(spark), skewed_orders(spark, 60))
    users = buckets.store_customers(customers, USERS, str(tmp_path / "u"), 3)
    try:
        for n, part in enumerate((facts, facts.where("order_id < 0"))):
            orders = buckets.store_orders(part, ORDERS, str(tmp_path / f"o{n}"), 3, most_hot=5)
            left = buckets.with_customers(orders, users.select("user_id", "is_bad_payer"), "left")
            assert left.count() == part.count()
            assert left.where("user_id IS NULL AND is_bad_payer IS NOT NULL").count() == 0
    finally:
        buckets.drop(spark, ORDERS, USERS)
