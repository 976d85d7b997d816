"""Estimated distinct customers against exact counts, at several sizes and over united months."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from riskloom.operators import sketches


def orders_of(spark, customers):
    """Every customer orders in three months, in two segments."""
    start = F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")
    return spark.range(customers * 3).select(
        (F.col("id") % customers).alias("user_id"),
        (start + F.make_dt_interval((F.col("id") / customers).cast("int") * 31)).alias("order_timestamp"),
        F.when(F.col("id") % customers < customers / 10, "few").otherwise("many").alias("segment"),
    )


@pytest.mark.parametrize("customers", [50, 5_000, 500_000])
def test_error_at_several_sizes(spark, customers):
    orders = orders_of(spark, customers)
    met = sketches.clients_in(sketches.monthly_sketches(orders, ["segment"]), ["segment"])
    exact = sketches.exact_clients(orders, ["segment"])
    for row in met.join(exact.withColumnsRenamed({"clients": "exact", "n": "n_exact"}), "segment").collect():
        assert abs(row["clients"] - row["exact"]) <= 1 + 0.033 * row["exact"]  # four standard errors
        assert row["n"] == row["n_exact"]


def test_united_months_count_a_customer_once(spark):
    orders = orders_of(spark, 2_000)
    monthly = sketches.monthly_sketches(orders, ["segment"])
    assert monthly.count() == 6
    one = F.col("mes") == F.lit("2024-01-01").cast("date")
    for months in (None, one):
        got = {r["segment"]: r["clients"] for r in sketches.clients_in(monthly, ["segment"], months).collect()}
        assert got["few"] == pytest.approx(200, rel=0.033) and got["many"] == pytest.approx(1800, rel=0.033)


def test_fewer_bits_are_smaller_and_coarser(spark):
    orders = orders_of(spark, 20_000)
    sizes = [
        sketches.monthly_sketches(orders, [], bits=bits).agg(F.max(F.octet_length("clients"))).first()[0]
        for bits in (8, 14)
    ]
    assert sizes[0] * 10 < sizes[1] < 20_000


def test_empty_and_missing(spark):
    orders = orders_of(spark, 10)
    none = sketches.monthly_sketches(orders.where("user_id < 0"), ["segment"])
    assert sketches.clients_in(none, ["segment"]).count() == 0
    unknown = orders.withColumn("user_id", F.lit(None).cast("bigint"))
    row = sketches.clients_in(sketches.monthly_sketches(unknown, []), []).first()
    assert (row["clients"], row["n"]) == (0, 30)
