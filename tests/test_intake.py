"""Orders taken in with bounded state: late, repeated and flagged ones, and scores that change meanwhile."""

from __future__ import annotations

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from riskloom.operators import curves, forest
from riskloom.operators.split import training_frame
from riskloom.plans.queries import Tables
from riskloom.streaming import flags, intake
from tests.frames import values

COLUMNS = "order_id bigint, user_id bigint, created_at timestamp_ntz"
START = datetime(2024, 1, 1)
SCORES = "user_id bigint, score double"


def hours(n: float) -> datetime:
    return START + timedelta(hours=n)


class Feed:
    """A folder of deliveries and the two streams over it."""

    def __init__(self, spark, path, delay="10 hours"):
        self.spark, self.path, self.delay = spark, str(path), delay
        self.source, self.out, self.scores = (f"{path}/{name}" for name in ("in", "out", "scores"))
        self.delivered = []

    def deliver(self, *rows):
        """Rows of (order_id, user_id, created_at)."""
        frame = self.spark.createDataFrame(list(rows), COLUMNS)
        frame.coalesce(1).write.mode("append").parquet(self.source)
        self.delivered += rows
        stream = self.spark.readStream.schema(COLUMNS).parquet(self.source)
        return intake.take_in(stream, COLUMNS, self.out, self.scores, self.delay)

    def flagged(self):
        schema = f"{COLUMNS}, score double, is_high_risk int, score_version string, batch int"
        return self.spark.read.schema(schema).parquet(f"{self.out}/flagged").orderBy("order_id")

    def late(self):
        rows = self.spark.read.parquet(f"{self.out}/received").where("late = 1")
        return sorted(r["order_id"] for r in rows.collect())


@pytest.fixture
def feed(spark, tmp_path):
    made = Feed(spark, tmp_path)
    scores = spark.createDataFrame([(1, 0.9), (2, 0.1)], SCORES)
    intake.publish_scores(scores, 0.5, made.scores, buckets=2)
    yield made
    for table in spark.catalog.listTables():
        if table.name.startswith("riskloom_scores_"):
            spark.sql(f"DROP TABLE {table.name}")


def test_every_row_is_late_flagged_or_repeated(feed):
    feed.deliver((1, 1, hours(0)), (2, 2, hours(20)), (2, 2, hours(20)), (3, 3, hours(1)))
    # The mark is hour 10: what is not newer is late.
    feed.deliver((4, 1, hours(10)), (5, 1, hours(10.001)), (2, 2, hours(20)), (1, 1, hours(0)), (6, 2, hours(40)))
    feed.deliver((6, 2, hours(40)), (5, 1, hours(10.001)), (7, None, hours(31)), (8, 1, None))
    assert feed.late() == [1, 4, 5, 8]
    assert values(feed.flagged(), "order_id", "score", "is_high_risk") == [
        (1, 0.9, 1), (2, 0.1, 0), (3, None, 0), (5, 0.9, 1), (6, 0.1, 0), (7, None, 0),
    ]
    total = intake.accounts(feed.spark, feed.out, COLUMNS, ["user_id"]).agg(
        *[F.sum(name).alias(name) for name in ("received", "late", "flagged", "repeated", "high_risk")]
    )
    assert tuple(total.first()) == (13, 4, 6, 3, 2)


def test_state_stays_level(feed):
    """A hundred orders an hour-and-a-half apart in forty batches: only those of the delay are remembered."""
    held = []
    for batch in range(14):
        rows = [(100 * batch + i, i % 3, hours(24 * batch + i / 10)) for i in range(100)]
        again = [rows[i] for i in range(90, 100)]
        _, progress = feed.deliver(*rows, *again)
        held.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 300 and max(held[5:]) <= max(held[2:5])
    counts = Counter(r["order_id"] for r in feed.flagged().collect())
    assert len(counts) == 1400 and set(counts.values()) == {1}


def test_a_batch_uses_the_scores_published_before_it(spark, feed, tmp_path):
    """The model is trained again between two batches; the second uses the new one's scores and threshold."""
    frame = training_frame(Tables(spark, "/root/testdata/sf0.01").features).cache()
    users = [r["user_id"] for r in frame.select("user_id").orderBy("user_id").limit(50).collect()]
    expected = {}
    for number, trees in enumerate((2, 5)):
        model, held_out = forest.train_and_score(frame, trees=trees)
        best = curves.best_f1_threshold(curves.pr_curve(held_out))
        forest.save(model, best, str(tmp_path / "model"))
        model, threshold = forest.load(spark, str(tmp_path / "model"))
        flagged = forest.flag_customers(model, threshold, frame)
        version = intake.publish_scores(flagged, threshold, feed.scores, buckets=2)
        feed.deliver(*[(1000 * number + i, user, hours(number)) for i, user in enumerate(users)])
        for row in flagged.where(F.col("user_id").isin(users)).collect():
            expected[1000 * number + users.index(row["user_id"])] = (row["score"], row["is_high_risk"], version)
    got = {r["order_id"]: (r["score"], r["is_high_risk"], r["score_version"]) for r in feed.flagged().collect()}
    assert got == expected
    assert len({v for _, _, v in got.values()}) == 2
    assert any(got[i][0] != got[1000 + i][0] for i in range(50))


def test_a_batch_that_is_run_again_leaves_one_result(spark, feed, monkeypatch):
    feed.deliver((1, 1, hours(0)), (2, 2, hours(30)))
    calls = []
    plain = flags.flagged

    def breaks_once(*args, **more):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return plain(*args, **more)

    monkeypatch.setattr(intake.flags, "flagged", breaks_once)
    with pytest.raises(Exception, match="lost"):
        feed.deliver((2, 2, hours(30)), (3, 1, hours(31)), (4, 1, hours(5)))
    newer = spark.createDataFrame([(1, 0.2), (2, 0.8)], SCORES)
    version = intake.publish_scores(newer, 0.5, feed.scores, buckets=2)
    feed.deliver((5, 2, hours(32)))
    assert values(feed.flagged(), "order_id", "score") == [(1, 0.9), (2, 0.1), (3, 0.2), (5, 0.8)]
    assert feed.flagged().where(F.col("score_version") == version).count() == 2
    assert feed.late() == [4]


def test_a_received_batch_that_is_run_again_is_divided_alike(spark, feed, monkeypatch):
    feed.deliver((1, 1, hours(0)), (2, 2, hours(30)))
    plain = intake.read_parquet

    def lost(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(intake, "read_parquet", lost)  # after the rows are written, before their mark
    with pytest.raises(Exception, match="lost"):
        feed.deliver((3, 1, hours(90)), (4, 1, hours(25)))
    monkeypatch.setattr(intake, "read_parquet", plain)
    feed.deliver((5, 1, hours(85)), (6, 1, hours(75)))
    assert [r["order_id"] for r in feed.flagged().collect()] == [1, 2, 3, 4, 5]
    assert feed.late() == [6]


def test_scores_of_another_application(spark, feed):
    version, _, _ = intake.published_scores(spark, feed.scores)
    spark.sql(f"DROP TABLE {intake.table_name(version)}")
    again, scores, threshold = intake.published_scores(spark, feed.scores)
    assert (again, threshold) == (version, 0.5)
    assert sorted(values(scores, "user_id", "score")) == [(1, 0.9), (2, 0.1)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        orders = spark.createDataFrame([(1, 1, hours(0))], COLUMNS)
        plan = flags.flagged(orders, scores, 0.5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    right = plan[plan.rindex("Sort [") :]
    assert "Bucketed: true" in right and "Exchange" not in right


def test_orders_keep_further_columns(spark, feed):
    columns = f"{COLUMNS}, delivery int"
    spark.createDataFrame([(1, 1, hours(0), 7)], columns).write.parquet(feed.source)
    stream = spark.readStream.schema(columns).parquet(feed.source)
    intake.take_in(stream, columns, feed.out, feed.scores, "1 hour")
    assert values(intake.accounts(spark, feed.out, columns, ["delivery"]), "delivery", "flagged") == [(7, 1)]
    assert "delivery" in spark.read.parquet(f"{feed.out}/flagged").columns
