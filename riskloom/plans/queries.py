"""Every registered query: (session, folder with the test tables) -> DataFrame.

Each reads the raw tables. Where a result depends on customers only, the orders are aggregated
by user before anything is joined; hour and shift results go through the hourly profile; only
results that need single orders next to their customer join the two.
"""

from __future__ import annotations

from collections.abc import Callable
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import schemas
from riskloom.functions import labels as L
from riskloom.operators import (
    curves,
    features,
    forest,
    histories,
    hourly,
    refine,
    report,
    segments,
    sketches,
    split,
    trees,
)
from riskloom.plans import monthly
from riskloom.session import durable, new_path, remembered
from riskloom.sources import buckets, files, records, testdata
from riskloom.streaming import flags, intake

# Sample floor for the state report: the default would leave no state at the test scale.
STATE_SAMPLE = 60


class Tables:
    """The frames the queries start from.

    All are lazy but the ``stored_`` ones. Those are written once because their query reads them
    several times: one pass over the raw tables, and one customer per row to write, is cheaper.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    @cached_property
    def raw_users(self) -> DataFrame:
        return testdata.raw_users(self.spark, self.folder)

    @cached_property
    def raw_orders(self) -> DataFrame:
        return testdata.raw_orders(self.spark, self.folder)

    @cached_property
    def demographics(self) -> DataFrame:
        return refine.user_demographics(self.raw_users)

    @cached_property
    def users(self) -> DataFrame:
        return refine.refined_users(self.raw_users, self.raw_orders)

    @cached_property
    def refined_orders(self) -> DataFrame:
        return refine.refined_orders(self.raw_orders, self.demographics)

    @cached_property
    def customers(self) -> DataFrame:
        return features.customers_from_raw(self.raw_users, self.raw_orders)

    @cached_property
    def features(self) -> DataFrame:
        return features.features_from_raw(self.raw_users, self.raw_orders)

    @cached_property
    def clients(self) -> DataFrame:
        return features.client_bands(self.features)

    @cached_property
    def stored_clients(self) -> DataFrame:
        return durable(self.clients)

    @cached_property
    def stored_users(self) -> DataFrame:
        return durable(self.users)

    def orders(self, *customer_columns: str) -> DataFrame:
        """Single orders beside their customer.

        The customers are stored, one row each: the engine splits a hot user only where both sides
        of a join come straight from a shuffle, and an aggregation by user would not.
        """
        facts = refine.order_facts(self.raw_orders)
        return features.orders_modeling(facts, self.stored_users, "inner", customer_columns)

    @cached_property
    def profile(self) -> DataFrame:
        return hourly.hourly_profile_from_raw(self.raw_users, self.raw_orders)

    @cached_property
    def training(self) -> DataFrame:
        return split.training_frame(self.features)

    @cached_property
    def stored_training(self) -> DataFrame:
        return durable(self.training)

    @cached_property
    def scored(self) -> DataFrame:
        """Customers with a stand-in score that any SQL engine computes alike."""
        points = F.pmod(
            F.col("user_id") * 7919 + F.col("total_orders_calculated") * 31, F.lit(1000)
        )
        return self.features.select(
            "user_id", F.col(L.TARGET).alias("y"), (points / 1000.0).alias("score")
        )

    @cached_property
    def curve(self) -> DataFrame:
        return curves.pr_curve(self.scored)

    @cached_property
    def predictions(self) -> DataFrame:
        stored = durable(self.scored)
        best = curves.best_f1_threshold(curves.pr_curve(stored))
        return report.threshold_predictions(stored, best.select("threshold").scalar())

    @cached_property
    def trained(self) -> tuple[str, DataFrame]:
        """Where the fitted model is stored, and the scored held-out customers.

        The forest is fitted once for all queries that need it, as long as its files and the tables
        of the folder stay what they are.
        """
        state = files.state(self.spark, *testdata.paths(self.folder))
        paths = remembered(self.spark, ("forest", self.folder, state), self._train)
        return paths[0], files.read_parquet(self.spark, paths[1], schemas.SCORED)

    def _train(self) -> tuple[str, str]:
        paths = self.new_path("risk-model"), self.new_path("risk-scores")
        model, held_out = forest.train_and_score(self.stored_training)
        files.write_parquet(held_out, paths[1])
        scored = files.read_parquet(self.spark, paths[1], schemas.SCORED)
        forest.save(model, curves.best_f1_threshold(curves.pr_curve(scored)), paths[0])
        return paths

    def new_path(self, name: str) -> str:
        return new_path(self.spark, name)


def behavior_features(t: Tables) -> DataFrame:
    # Aggregating first leaves one row per user to match with the refined users.
    behavior = features.behavior_features(refine.order_facts(t.raw_orders))
    return behavior.join(t.demographics.select("user_id"), "user_id", "left_semi")


def utc_times(t: Tables) -> DataFrame:
    """Creation times that came as text with an offset, or with a zone, as zoneless UTC."""
    hours = (F.col("order_id") % 25 - 12).cast("int")
    there = F.col("created_at") + F.make_dt_interval(hours=hours)
    offset = F.format_string("%+03d:00", hours)
    text = F.concat(F.date_format(there, "yyyy-MM-dd'T'HH:mm:ss"), offset)
    as_text = t.raw_orders.select("order_id", text.alias("from_text"))
    both = as_text.withColumn("from_zone", F.to_timestamp("from_text"))
    return refine.naive_utc(refine.naive_utc(both, "from_text"), "from_zone")


def split_counts(t: Tables) -> DataFrame:
    assigned = split.stratified_split(t.stored_training)
    return assigned.groupBy(L.TARGET).agg(
        F.count_if(F.col("is_test") == 0).alias("n_train"),
        F.count_if(F.col("is_test") == 1).alias("n_test"),
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """Sums of fractions depend on their order in the last digits; nine decimals do not."""
    return df.withColumns({name: F.round(name, 9) for name in names})


def csv_features(t: Tables) -> DataFrame:
    path = t.new_path("features-csv")
    files.write_csv(t.features, path)
    return files.read_csv(t.spark, path, schemas.FEATURES_MODELING)


def csv_orders(t: Tables) -> DataFrame:
    path = t.new_path("orders-csv")
    files.write_csv(t.orders(), path)
    return files.read_csv(t.spark, path, schemas.ORDERS_MODELING)


def parquet_orders(t: Tables) -> DataFrame:
    path = t.new_path("orders-parquet")
    files.write_parquet_by_month(t.orders(), path, "order_timestamp")
    return files.read_parquet(t.spark, path, schemas.ORDERS_MODELING).drop("mes")


CSV_NOTES = "order_id bigint, note string, created_at timestamp_ntz"


def csv_records(t: Tables) -> DataFrame:
    """Orders with notes of two lines, some with an id or a time that does not fit: rows and rejects by reason."""
    note = F.concat("status", F.lit(',\n"'), F.col("user_id").cast("string"), F.lit('"'))
    text_id, text_time = (F.col(name).cast("string") for name in ("order_id", "created_at"))
    written = t.raw_orders.select(
        F.when(F.col("order_id") % 40 == 0, F.concat(F.lit("no "), text_id)).otherwise(text_id).alias("order_id"),
        note.alias("note"),
        F.when(F.col("order_id") % 41 == 0, "unknown").otherwise(text_time).alias("created_at"),
    )
    path = t.new_path("notes-csv")
    files.write_csv(written, path)
    found = records.read_records(t.spark, path, CSV_NOTES, line_breaks=True)
    fits = found.rows.select(
        F.lit("none").alias("reason"), F.md5(F.concat("order_id", F.lit(":"), "note", F.lit(":"), "created_at")).alias("digest")
    )
    rejects = found.rejects.select("reason", F.lit(None).cast("string").alias("digest"))
    first = F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint")
    return fits.union(rejects).groupBy("reason").agg(F.count("*").alias("n"), F.sum(first).alias("digests"))


def bucketed(t: Tables, make: Callable[[buckets.Orders, DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` returns for orders and customers stored in the same buckets.

    With few hot customers allowed, so that some of the test tables' are stored apart."""
    orders_name, users_name = (f"riskloom_{name}_{uuid.uuid4().hex}" for name in ("orders", "users"))
    count = int(t.spark.conf.get("spark.sql.shuffle.partitions"))
    users = buckets.store_customers(t.users, users_name, t.new_path("bucketed-users"), count)
    facts = refine.order_facts(t.raw_orders)
    orders = buckets.store_orders(facts, orders_name, t.new_path("bucketed-orders"), count, most_hot=300)
    result = durable(make(orders, users))
    buckets.drop(t.spark, orders_name, users_name)
    return result


def bucketed_orders(t: Tables) -> DataFrame:
    def make(orders: buckets.Orders, users: DataFrame) -> DataFrame:
        customer = users.select("user_id", "is_bad_payer", "account_created_at")
        return features.finish_orders(buckets.with_customers(orders, customer))

    return bucketed(t, make)


def client_estimates(t: Tables) -> DataFrame:
    """By shift and account age the orders of odd and of all months, and whether estimates of customers hold."""
    orders = durable(t.orders())
    by = ["turno_pedido", "faixa_tempo_conta"]
    sketched = durable(sketches.monthly_sketches(orders, by))
    parts = []
    for period, months in (("all", None), ("odd", F.month("mes") % 2 == 1)):
        met = sketches.exact_clients(orders, by, months).join(
            sketches.clients_in(sketched, by, months).withColumnRenamed("clients", "estimate").drop("n"), by
        )
        # Four standard errors, and one customer where there are few.
        near = F.abs(F.col("estimate") - F.col("clients")) <= 1 + 0.035 * F.col("clients")
        parts.append(met.select(F.lit(period).alias("period"), *by, "n", "clients", near.alias("holds")))
    return parts[0].union(parts[1])


def rf_report(t: Tables) -> DataFrame:
    scored = t.trained[1]
    best = curves.best_f1_threshold(curves.pr_curve(scored))
    return report.classification_report(
        report.threshold_predictions(scored, best.select("threshold").scalar())
    )


def batch_scoring(t: Tables) -> DataFrame:
    """Score every customer with the stored model and threshold."""
    return forest.flag_customers(*forest.load(t.spark, t.trained[0]), t.stored_training)


def forest_checks(t: Tables) -> DataFrame:
    """Per class the scored held-out customers, and how many of them break a rule."""
    model, threshold = forest.load(t.spark, t.trained[0])
    again = forest.flag_customers(model, threshold, t.stored_training)
    met = t.trained[1].join(again.withColumnRenamed("score", "after"), "user_id")
    flagged = F.col("is_high_risk") == 1
    return met.groupBy(F.col("y").alias(L.TARGET)).agg(
        F.count("*").alias("n_scored"),
        F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"),
        F.count_if(flagged != (F.col("score") >= threshold)).alias("wrong_flags"),
        F.count_if(F.col("score") != F.col("after")).alias("changed_after_reload"),
    )


def forest_walk(t: Tables) -> DataFrame:
    """Per class all customers, and how many of their scores the stored trees, walked by joins, do not give.

    Flags are held against the published threshold too, and the scores of the held-out customers.
    """
    path = t.trained[0]
    model, threshold = forest.load(t.spark, path)
    walked = trees.walk(forest.load_nodes(t.spark, path), t.stored_training)
    flagged = forest.flag_customers(model, threshold, t.stored_training)
    held_out = t.trained[1].select("user_id", F.col("score").alias("before"))
    met = (
        t.stored_training.select("user_id", L.TARGET)
        .join(walked.withColumnRenamed("score", "walked"), "user_id", "left")
        .join(flagged, "user_id", "left")
        .join(held_out, "user_id", "left")
    )
    differs = lambda name: ~F.coalesce(F.abs(F.col(name) - F.col("walked")) < 1e-9, F.lit(False))
    high = (F.col("walked") >= F.lit(threshold) - 1e-9).cast("int")
    low = (F.col("walked") >= F.lit(threshold) + 1e-9).cast("int")
    return met.groupBy(L.TARGET).agg(
        F.count("*").alias("n"),
        F.count("before").alias("n_held_out"),
        F.count_if(differs("score")).alias("wrong_scores"),
        F.count_if(F.col("before").isNotNull() & differs("before")).alias("wrong_held_out"),
        F.count_if(~F.col("is_high_risk").between(low, high)).alias("wrong_flags"),
    )


def forest_fit(t: Tables) -> DataFrame:
    nodes = durable(forest.load_nodes(t.spark, t.trained[0]))
    return trees.fit_checks(nodes, L.FOREST_TREES, L.FOREST_MIN_LEAF)


def streaming_flags(t: Tables) -> DataFrame:
    scored = durable(t.scored)
    best = curves.best_f1_threshold(curves.pr_curve(scored)).first()
    if best is None:
        raise ValueError("no threshold: there is no bad payer among the customers")
    name = f"riskloom_scores_{uuid.uuid4().hex}"
    stored = flags.store_scores(scored, name, t.new_path("scores"))
    out = t.new_path("flags")
    incoming = testdata.order_stream(t.spark, t.folder)
    flagged = flags.flag_orders(incoming, stored, best["threshold"])
    flags.write_available(flagged, out, t.new_path("state"))
    t.spark.sql(f"DROP TABLE {name}")
    return t.spark.read.schema(schemas.ORDER_FLAGS).parquet(out)


def loaded_by_month(t: Tables) -> str:
    """Where the tables lie that three loads of a third of the months each and a correction made.

    The second load has one month wrong: all orders complete, with twice the items. The last one corrects it.
    """
    # The raw orders as a table of their own: the loads read months of it, each several times.
    raw = durable(t.raw_orders)
    orders = raw.withColumn(histories.MONTH, histories.month_of("created_at"))
    found = orders.select(histories.MONTH).distinct().orderBy(histories.MONTH)
    months = [row[0] for row in found.collect()]  # one row per month
    third = -(-len(months) // 3)
    loads = [months[i : i + third] for i in range(0, len(months), third)]
    mistaken = loads[1][0] if len(loads) > 1 else months[0]
    wrong = F.col(histories.MONTH).eqNullSafe(F.lit(mistaken))
    bad = orders.withColumns(
        {
            "status": F.when(wrong, "Complete").otherwise(F.col("status")),
            "num_of_item": F.when(wrong, 2 * F.col("num_of_item")).otherwise(F.col("num_of_item")),
        }
    )
    path = t.new_path("by-month")
    for number, load in enumerate(loads):
        source = bad if number == 1 or len(loads) == 1 else orders
        monthly.load_months(t.raw_users, source.drop(histories.MONTH), path, load)
    monthly.load_months(t.raw_users, raw, path, [mistaken])
    return path


def monthly_table(name: str, schema: str) -> Callable[[Tables], DataFrame]:
    def read(t: Tables) -> DataFrame:
        state = files.state(t.spark, *testdata.paths(t.folder))
        key = ("by month", t.folder, state)
        path = remembered(t.spark, key, lambda: loaded_by_month(t))
        return files.read_parquet(t.spark, f"{path}/{name}", schema).select(*names(schema))

    return read


def names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


# The orders of the test tables as deliveries: their time span in so many periods.
PERIODS = 3
DELIVERED = "order_id bigint, user_id bigint, created_at timestamp_ntz, delivery int"


def deliveries(t: Tables) -> tuple[DataFrame, int]:
    """(order_id, user_id, created_at, delivery) of every delivered row, and half a period in seconds.

    Orders are delivered after their period. One in 13 is delivered again with the next one, and one
    in 17 two deliveries late.
    """
    orders = t.raw_orders.select("order_id", "user_id", "created_at")
    seconds = F.unix_timestamp(F.col("created_at").cast("timestamp"))
    span = orders.agg(F.min(seconds).alias("low"), F.max(seconds).alias("high")).first()
    length = span["high"] - span["low"] + 1
    period = F.floor((seconds - span["low"]) * PERIODS / length).cast("int")
    late = F.when(F.col("order_id") % 17 == 0, 2).otherwise(0)
    again = F.when(F.col("order_id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    dealt = orders.select("*", (period + late).alias("_first"), F.explode(again).alias("_again"))
    rows = dealt.select("order_id", "user_id", "created_at", (F.col("_first") + F.col("_again")).alias("delivery"))
    return rows, length // (2 * PERIODS)


def streaming_intake(t: Tables) -> DataFrame:
    """By delivery what became of its orders; from the fourth delivery on by scores that were published meanwhile."""
    rows, delay = deliveries(t)
    dealt = durable(rows)
    base, scores_path, out = t.new_path("deliveries"), t.new_path("scores"), t.new_path("intake")
    scored = durable(t.scored)
    turned = scored.withColumn("score", 1 - F.col("score"))
    published = [intake.publish_scores(scored, 0.5, scores_path)]
    for number in range(PERIODS + 3):
        if number == PERIODS:
            published.append(intake.publish_scores(turned, 0.5, scores_path))
        dealt.where(F.col("delivery") == number).write.mode("append").parquet(base)
        stream = t.spark.readStream.schema(DELIVERED).parquet(base)
        intake.take_in(stream, DELIVERED, out, scores_path, f"{delay} seconds")
    for version in published:
        t.spark.sql(f"DROP TABLE IF EXISTS {intake.table_name(version)}")
    return intake.accounts(t.spark, out, DELIVERED, ["delivery"])


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # refinement
    "user_order_aggregates": lambda t: refine.user_order_aggregates(t.raw_orders),
    "refined_users": lambda t: t.users,
    "refined_orders": lambda t: t.refined_orders,
    "utc_times": utc_times,
    # feature tables
    "behavior_features": behavior_features,
    "features_modeling": lambda t: t.features,
    "orders_modeling": lambda t: t.orders(),
    "client_bands": lambda t: t.clients,
    # key figures and segments
    "kpis": lambda t: segments.kpis(t.customers),
    "conversion_breakdown": lambda t: segments.conversion_breakdown(segments.kpis(t.customers)),
    "rate_by_account_age": lambda t: segments.rate_by_account_age(t.orders()),
    "rate_by_age_gender": lambda t: segments.rate_by_age_gender(t.clients),
    "rate_by_state": lambda t: segments.rate_by_state(t.features),
    "rate_by_state_min_sample": lambda t: segments.rate_by_state(t.features, STATE_SAMPLE),
    "rate_by_clv": lambda t: segments.rate_by_clv(t.clients),
    "rate_by_age_x_account_age": lambda t: segments.rate_by_age_x_account_age(t.orders("age")),
    "rate_labels": lambda t: segments.all_rate_labels(t.stored_clients, t.orders()),
    # hours and shifts
    "detractors_by_shift": lambda t: hourly.detractors_by_shift(t.profile),
    "shift_gap": lambda t: hourly.shift_gap(t.profile),
    "rate_by_hour": lambda t: hourly.rate_by_hour(t.profile),
    "hours_above_average": lambda t: hourly.hours_above_average(t.profile),
    "value_at_risk_by_hour": lambda t: hourly.value_at_risk_by_hour(t.profile),
    "peak_value_at_risk_hour": lambda t: hourly.peak_value_at_risk_hour(t.profile),
    "shift_hour_index": lambda t: hourly.with_shift_hour_index(t.refined_orders).select(
        "order_id", "order_hour", "turno_pedido", "shift_hour_index"
    ),
    # learning
    "training_frame": lambda t: t.training,
    "stratified_split": lambda t: split.stratified_split(t.stored_training).select(
        "user_id", L.TARGET, "is_test"
    ),
    "split_counts": split_counts,
    "class_weights": lambda t: split.class_weights(t.features),
    "rf_scores": lambda t: t.trained[1],
    "rf_metrics": lambda t: curves.summary(curves.pr_curve(t.trained[1])),
    "rf_report": rf_report,
    "batch_scoring": batch_scoring,
    "forest_checks": forest_checks,
    "forest_walk": forest_walk,
    "forest_fit": forest_fit,
    # ranking metrics
    "pr_curve": lambda t: t.curve.select("score", "tp", "fp", "precision", "recall", "f1"),
    "average_precision": lambda t: rounded(curves.average_precision(t.curve), "average_precision"),
    "roc_auc": lambda t: rounded(curves.roc_auc(t.curve), "roc_auc"),
    "best_f1_threshold": lambda t: curves.best_f1_threshold(t.curve),
    "threshold_predictions": lambda t: t.predictions,
    "classification_report": lambda t: rounded(
        report.classification_report(t.predictions), "precision", "recall", "f1_score"
    ),
    # files and streams
    "csv_roundtrip": csv_features,
    "csv_roundtrip_orders": csv_orders,
    "csv_records": csv_records,
    "parquet_roundtrip": parquet_orders,
    "bucketed_orders": bucketed_orders,
    "bucketed_refined_orders": lambda t: bucketed(t, buckets.known_customers_only),
    "client_estimates": client_estimates,
    # month by month
    "monthly_user_months": monthly_table("user_months", schemas.USER_MONTHS),
    "monthly_refined_users": monthly_table("refined_users", schemas.REFINED_USERS),
    "monthly_refined_orders": monthly_table("refined_orders", schemas.REFINED_ORDERS),
    "monthly_features": monthly_table("features_modeling", schemas.FEATURES_MODELING),
    "monthly_orders": monthly_table("orders_modeling", schemas.ORDERS_MODELING),
    "streaming_flags": streaming_flags,
    "streaming_intake": streaming_intake,
}


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(query: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: query(Tables(spark, folder))

    return {name: bind(query) for name, query in QUERIES.items()}
