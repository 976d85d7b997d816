from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from riskloom.__main__ import main
from riskloom.plans import jobs
from riskloom.plans.queries import QUERIES, STATE_SAMPLE, Tables
from riskloom.session import shared_dir
from tests.frames import assert_equal


@pytest.mark.parametrize("csv", [False, True])
def test_stored_tables_give_the_same_report(spark, folder, tmp_path, csv):
    t = Tables(spark, folder)
    jobs.build_tables(t.raw_users, t.raw_orders, str(tmp_path), csv)
    stored = jobs.load_tables(spark, str(tmp_path), csv)
    assert set(stored) == {"refined_users", "refined_orders", "features_modeling", "orders_modeling"}
    for name, df in stored.items():
        assert_equal(df, QUERIES[name](t))
        assert spark.table(name).count() == df.count()
    report = jobs.risk_report(stored["features_modeling"], stored["orders_modeling"], STATE_SAMPLE)
    wanted = {name for name in QUERIES if name.startswith("rate_") or "hour" in name}
    assert wanted | {"kpis", "conversion_breakdown", "detractors_by_shift", "shift_gap"} == set(report)
    for name, df in report.items():
        assert_equal(df, QUERIES[name](t))


def test_order_tables_prune_by_month(spark, folder, tmp_path):
    t = Tables(spark, folder)
    jobs.build_tables(t.raw_users, t.raw_orders, str(tmp_path))
    jobs.load_tables(spark, str(tmp_path))
    for name in ("refined_orders", "orders_modeling"):
        months = [r.mes for r in spark.table(name).select("mes").distinct().collect()]
        one = spark.table(name).where(F.col("mes") == min(months))
        assert "PartitionFilters: [isnotnull(mes" in one._jdf.queryExecution().toString()
        assert 0 < one.count() < spark.table(name).count()


def test_jobs_leave_nothing_behind(spark, folder, tmp_path):
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    t = Tables(spark, folder)
    jobs.build_tables(t.raw_users, t.raw_orders, str(tmp_path / "tables"))
    clients = Tables(spark, "/root/testdata/sf0.01").features
    jobs.train_model(clients, str(tmp_path / "model"), trees=3)
    main(["report", str(tmp_path / "tables"), str(tmp_path / "report")])
    assert set(shared.iterdir()) == before


def test_report_holds_every_segment(spark, tmp_path):
    """More states than any printing would show."""
    clients = Tables(spark, "/root/testdata/sf0.01").features
    states = F.concat(F.lit("state "), F.col("user_id").cast("string"))
    tables = tmp_path / "tables"
    clients.withColumn("state", states).write.parquet(str(tables / "features_modeling"))
    orders = Tables(spark, "/root/testdata/sf0.001").orders()
    for name, df in (("orders_modeling", orders), ("refined_users", None), ("refined_orders", None)):
        empty = spark.createDataFrame([], jobs.STORED[name])
        (empty if df is None else df).write.parquet(str(tables / name))
    main(["report", str(tables), str(tmp_path / "out")])
    found = spark.read.parquet(str(tmp_path / "out" / "rate_by_state")).count()
    assert found == clients.count() > 800


def test_training_job(spark, tmp_path):
    clients = Tables(spark, "/root/testdata/sf0.01").features
    result = jobs.train_model(clients, str(tmp_path), trees=5)
    assert result["summary"].count() == 1
    assert result["classification_report"].count() == 10
    assert (tmp_path / "model").is_dir() and (tmp_path / "threshold").is_dir()


def test_command_line(spark, tmp_path, capsys):
    t = Tables(spark, "/root/testdata/sf0.01")
    users, orders, tables, report, model, out = (
        str(tmp_path / name) for name in ("users", "orders", "tables", "report", "model", "out")
    )
    t.raw_users.write.parquet(users)
    t.raw_orders.write.parquet(orders)
    main(["build", users, orders, tables])
    main(["report", tables, report, "--min-sample", "60"])
    assert "rate_by_state_min_sample" in capsys.readouterr().out
    ages = spark.read.parquet(f"{report}/rate_by_account_age")
    assert "4. +365 dias" in [row[0] for row in ages.select("faixa_tempo_conta").collect()]
    main(["train", tables, model])
    assert "weighted avg" in capsys.readouterr().out
    main(["score", tables, model, out])
    scored = spark.read.parquet(out)
    assert scored.columns == ["user_id", "score", "is_high_risk"]
    assert scored.count() == t.features.count()
