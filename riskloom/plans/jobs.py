"""The pipeline as jobs: build the stored tables, report on them, train and keep the model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskloom import schemas
from riskloom.functions import labels as L
from riskloom.operators import curves, features, forest, hourly, refine, report, segments, split
from riskloom.session import durable, temporary
from riskloom.sources import files

STORED = {
    "refined_users": schemas.REFINED_USERS,
    "refined_orders": schemas.REFINED_ORDERS,
    "features_modeling": schemas.FEATURES_MODELING,
    "orders_modeling": schemas.ORDERS_MODELING,
}


def build_tables(raw_users: DataFrame, raw_orders: DataFrame, path: str, csv: bool = False) -> None:
    """Write refined users and orders, the feature table and the orders table under ``path``.

    As Parquet, the two order tables have a folder per month (column ``mes``). One pass over
    the raw orders aggregates them by user, and each order table joins them to the result. Creation
    times may carry a zone; the tables hold them in UTC.
    """
    raw_users, raw_orders = refine.naive_utc(raw_users), refine.naive_utc(raw_orders)
    write = files.write_csv if csv else files.write_parquet

    def write_orders(df: DataFrame, name: str) -> None:
        if csv:
            files.write_csv(df, f"{path}/{name}")
        else:
            files.write_parquet_by_month(df, f"{path}/{name}", "order_timestamp")

    with temporary(raw_users.sparkSession):
        customers = durable(features.customers_from_raw(raw_users, raw_orders))
        users = customers.select(*refine.REFINED_USERS)
        write(users, f"{path}/refined_users")
        write(features.finish_features(customers), f"{path}/features_modeling")
        write_orders(refine.refined_orders(raw_orders, users), "refined_orders")
        facts = refine.order_facts(raw_orders)
        write_orders(features.orders_modeling(facts, users, "inner"), "orders_modeling")


def load_tables(spark: SparkSession, path: str, csv: bool = False) -> dict[str, DataFrame]:
    """Read the stored tables and make them available to SQL under their names.

    In SQL the order tables have their month, ``mes``, by which reads prune.
    """
    read = files.read_csv if csv else files.read_parquet
    return {
        name: files.register(read(spark, f"{path}/{name}", schema), name).drop("mes")
        for name, schema in STORED.items()
    }


def risk_report(
    clients: DataFrame, orders: DataFrame, min_sample: int = L.MIN_SAMPLE
) -> dict[str, DataFrame]:
    """Every figure of the report, from the stored feature and orders tables.

    Intermediate tables are written; compute the figures within :func:`riskloom.session.temporary`
    to have them removed afterwards.
    """
    # Clients are read by most of the figures, the profile of at most 25 rows by six of them.
    banded = durable(features.client_bands(clients))
    profile = durable(hourly.hourly_profile(orders))
    revenue = segments.order_kpis(orders).select("receita_total").scalar()
    figures = durable(segments.kpis(banded, revenue))
    with_age = orders.join(banded.select("user_id", "age"), "user_id")
    return {
        "kpis": figures,
        "conversion_breakdown": segments.conversion_breakdown(figures),
        "detractors_by_shift": hourly.detractors_by_shift(profile),
        "shift_gap": hourly.shift_gap(profile),
        "rate_by_hour": hourly.rate_by_hour(profile),
        "hours_above_average": hourly.hours_above_average(profile),
        "value_at_risk_by_hour": hourly.value_at_risk_by_hour(profile),
        "peak_value_at_risk_hour": hourly.peak_value_at_risk_hour(profile),
        "rate_by_account_age": segments.rate_by_account_age(orders),
        "rate_by_age_gender": segments.rate_by_age_gender(banded),
        "rate_by_state": segments.rate_by_state(banded),
        "rate_by_state_min_sample": segments.rate_by_state(banded, min_sample),
        "rate_by_clv": segments.rate_by_clv(banded),
        "rate_by_age_x_account_age": segments.rate_by_age_x_account_age(with_age),
        "rate_labels": segments.all_rate_labels(banded, orders),
        "shift_hour_index": hourly.with_shift_hour_index(orders).select(
            "order_id", "order_hour", "turno_pedido", "shift_hour_index"
        ),
    }


def train_model(clients: DataFrame, path: str, **forest_params: int) -> dict[str, DataFrame]:
    """Train on the feature table, publish model, threshold and evaluation as one version under ``path``.

    Returns the one-row summary and the per-class report at the default and tuned thresholds.
    """
    spark = clients.sparkSession
    with temporary(spark):
        model, held_out = forest.train_and_score(split.training_frame(clients), **forest_params)
        scored = durable(held_out)
        curve = curves.pr_curve(scored)
        best = curves.best_f1_threshold(curve)
        predictions = report.threshold_predictions(scored, best.select("threshold").scalar())
        evaluation = {
            "summary": curves.summary(curve),
            "classification_report": report.classification_report(predictions),
        }
        version = forest.save(model, best, path, more=evaluation)
    return {
        name: files.read_parquet(spark, f"{path}/{name}/{version}", df.schema)
        for name, df in evaluation.items()
    }
