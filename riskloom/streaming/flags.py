"""Flagging high-risk orders as they come in."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Of an order only these are needed to flag it.
ORDER_COLUMNS = ("order_id", "user_id", "created_at")


def store_scores(scores: DataFrame, table: str, path: str, buckets: int | None = None) -> DataFrame:
    """Store scores (user_id, score) laid out by user, for joins that move only the orders.

    ``buckets`` should be the number of shuffle partitions of the jobs that read the table, which
    is the default; ``path`` holds its files.
    """
    spark = scores.sparkSession
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid_out = scores.select("user_id", "score").repartition(count, "user_id")
    writer = laid_out.write.format("parquet").mode("overwrite").option("path", path)
    writer.bucketBy(count, "user_id").sortBy("user_id").saveAsTable(table)
    return spark.table(table)


def flag_orders(orders: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Attach the stored score of the customer to each order and flag it at the threshold.

    ``orders`` is a stream or a batch; ``scores`` is a stored table (user_id, score), unique on
    the user. An order of an unscored customer passes through without a flag. An order that is
    delivered again appears once: its id is remembered, for ever, so a late order is never
    dropped, and only the ids are kept between micro-batches. :mod:`riskloom.streaming.intake` has
    the same with bounded state. Users with very many orders are split by the engine's skew join.
    """
    return flagged(orders.dropDuplicates(["order_id"]), scores, threshold).withColumnRenamed(
        "created_at", "order_timestamp"
    )


def flagged(
    orders: DataFrame, scores: DataFrame, threshold: float, keep: Sequence[str] = ()
) -> DataFrame:
    """``orders`` with their customers' score and flag, and the columns named in ``keep``."""
    scored = orders.join(scores.select("user_id", "score"), "user_id", "left")
    high = F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0))
    return scored.select(*ORDER_COLUMNS, *keep, "score", high.alias("is_high_risk"))


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams that start within keep their state in RocksDB, on the executors' disks."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(
        key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_available(flags: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has arrived, write it to Parquet exactly once, and stop.

    The ids already seen are kept in RocksDB, on the executors' disks, with changes in
    ``checkpoint``.
    """
    with state_on_disk(flags.sparkSession):
        query = (
            flags.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
