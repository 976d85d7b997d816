"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from riskloom.operators import report
from riskloom.plans.queries import Tables
from riskloom.session import new_path, shared_dir

LAZY = [
    "users",
    "refined_orders",
    "features",
    "clients",
    "profile",
    "scored",
    "curve",
]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, folder, no_broadcast, name):
    plan = plan_of(getattr(Tables(spark, folder), name))
    assert not any(
        bad in plan
        for bad in ("CartesianProduct", "NestedLoop", "Python", "Pandas", "MapInArrow")
    )


def test_features_scan_orders_once_and_prune(spark, folder, no_broadcast):
    plan = plan_of(Tables(spark, folder).features)
    assert plan.count("orders.parquet") == 1
    assert "o_orderdate" not in plan and "PushedFilters: [IsNotNull(n_nationkey)" in plan


def test_profile_scans_orders_once(spark, folder, no_broadcast):
    plan = plan_of(Tables(spark, folder).profile.select("order_hour", "orders", "bad_orders"))
    assert plan.count("orders.parquet") == 1
    # Item counts are not needed, so the optimizer drops their join.
    assert "lineitem.parquet" not in plan


def test_orders_are_read_for_the_join_and_the_label_only(spark, folder, no_broadcast):
    plan = plan_of(Tables(spark, folder).orders())
    # The customers are stored before; there is no further pass over the keys.
    assert plan.count("orders.parquet") == 1 and plan.count("FileScan") == 3
    assert "BroadcastExchange" not in plan


def test_report_scans_the_predictions_once(spark, folder, tmp_path):
    path = str(tmp_path / "predictions")
    Tables(spark, folder).predictions.write.parquet(path)
    df = report.classification_report(spark.read.parquet(path))
    assert df.count() == 10
    assert plan_of(df).count("FileScan") == 1


def test_shared_folder_is_the_one_of_the_session(spark):
    set_by_caller = spark.sparkContext.getCheckpointDir()
    assert set_by_caller == shared_dir(spark)
    assert new_path(spark, "x").startswith(shared_dir(spark))
    assert new_path(spark, "x") != new_path(spark, "x")
    assert spark.sparkContext.getCheckpointDir() == set_by_caller


def test_shared_folder_without_a_checkpoint_folder():
    conf = {"spark.sql.warehouse.dir": "s3://bucket/warehouse"}
    context = SimpleNamespace(getCheckpointDir=lambda: None)
    session = SimpleNamespace(
        sparkContext=context, conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default))
    )
    assert shared_dir(session) == "s3://bucket/warehouse/riskloom-intermediate"
    conf["spark.checkpoint.dir"] = "hdfs://shared"
    assert shared_dir(session) == "hdfs://shared"
