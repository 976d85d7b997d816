"""Taking in orders with bounded state: late ones are set aside, repeated ones dropped, scores kept fresh.

Two streams, each with its own checkpoint:

1. :func:`receive` writes each micro-batch as it came, late orders apart from accepted ones. An order is late if it
   is not newer than the mark, the newest creation time of all earlier batches less the delay. The marks are
   stored with the batches, so a batch that is run again is divided in the same way.
2. :func:`flag_accepted` drops accepted orders that were delivered before, and flags the others. The ids of a
   delivery are remembered until the watermark has passed the delay, not for ever. Its watermark never is ahead of
   the first stream's mark, as it reads the same batches in the same order, so it drops nothing by time; and an
   order that passes the mark is still remembered. Every batch looks up the scores published last.

Both write a folder per batch, which a batch that is run again overwrites. So each delivered row ends up in
exactly one of three places: late, flagged, or repeated, which is what is accepted and not flagged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from riskloom.sources import publication
from riskloom.sources.files import read_parquet
from riskloom.streaming import flags

RECEIVED, FLAGGED, MARKS = "received", "flagged", "marks"
MARK = "mark timestamp_ntz"


def publish_scores(
    scores: DataFrame, threshold: float, path: str, buckets: int | None = None
) -> str:
    """Publish scores (user_id, score) with their threshold; running streams take them from their next batch on.

    They are laid out in ``buckets`` by user, by default as many as the session has shuffle partitions.
    """
    spark = scores.sparkSession
    version = publication.new_version(spark, path)
    count = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = table_name(version)
    flags.store_scores(scores, table, f"{path}/scores/{version}", count)
    layout = spark.createDataFrame([(threshold, count)], "threshold double, buckets int")
    layout.write.parquet(f"{path}/layout/{version}")
    publication.publish(spark, path, version)
    return version


def table_name(version: str) -> str:
    return f"riskloom_scores_{version.replace('-', '_')}"


def published_scores(spark: SparkSession, path: str) -> tuple[str, DataFrame, float]:
    """The version published last, its scores as a table in buckets, and its threshold."""
    version = publication.current(spark, path)
    layout = spark.read.parquet(f"{path}/layout/{version}").first()
    table = table_name(version)
    if not spark.catalog.tableExists(table):
        # Published by another application; the files hold their buckets in their names.
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} (user_id BIGINT, score DOUBLE) USING parquet "
            f"CLUSTERED BY (user_id) SORTED BY (user_id) INTO {layout['buckets']} BUCKETS "
            f"LOCATION '{path}/scores/{version}'"
        )
    return version, spark.table(table), layout["threshold"]


def receive(orders: DataFrame, path: str, checkpoint: str, delay: str) -> list[dict]:
    """Write what has arrived under ``path/received``, in a folder per batch and ``late`` 0 or 1.

    ``orders`` is a stream with a ``created_at``; orders without one are set aside with the late. ``delay`` is an interval such
    as ``2 days``: how much older than the newest order of earlier batches an order may be.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        mark = _mark(spark, path, number - 1)
        limit = F.lit(mark).cast("timestamp_ntz") - F.expr(f"INTERVAL {delay}")
        late = F.coalesce(F.col("created_at") <= limit, F.col("created_at").isNull()).cast("int")
        out = f"{path}/{RECEIVED}/batch={number}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(out)
        # Of the written files only one column is read; late orders cannot raise the mark.
        newest = read_parquet(spark, out, "created_at timestamp_ntz").agg(F.max("created_at").alias("mark"))
        before = F.lit(mark).cast("timestamp_ntz")
        newest.select(F.greatest("mark", before).alias("mark")).coalesce(1).write.mode(
            "overwrite"
        ).parquet(f"{path}/{MARKS}/batch={number}")

    return _run(orders.writeStream.foreachBatch(write), checkpoint)


def _mark(spark: SparkSession, path: str, number: int):
    """The newest creation time up to a batch; nothing before the first one."""
    if number < 0:
        return None
    return spark.read.schema(MARK).parquet(f"{path}/{MARKS}/batch={number}").first()["mark"]


def accepted(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """The accepted orders as a stream with the given columns."""
    rows = spark.readStream.schema(f"{columns}, batch int, late int").parquet(f"{path}/{RECEIVED}")
    return rows.where("late = 0").drop("batch", "late")


def once(orders: DataFrame, delay: str) -> DataFrame:
    """A stream's orders without those that were delivered before; ids are forgotten after ``delay``."""
    # Watermarks need an instant; times without a zone count from the same point in any session.
    since = "(created_at - TIMESTAMP_NTZ '1970-01-01 00:00:00')"
    timed = orders.withColumn("_at", F.expr(f"TIMESTAMP '1970-01-01 00:00:00Z' + {since}"))
    return timed.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["order_id"]).drop("_at")


def flag_accepted(
    orders: DataFrame, path: str, scores_path: str, checkpoint: str, delay: str
) -> list[dict]:
    """Flag the accepted orders that are new under ``path/flagged``, in a folder per batch.

    ``orders`` are those of :func:`accepted`, ``delay`` is that of :func:`receive`. Columns beyond those of an
    order are kept, and ``score_version`` says which scores were used.
    """

    def write(batch: DataFrame, number: int) -> None:
        version, scores, threshold = published_scores(batch.sparkSession, scores_path)
        flagged = flags.flagged(batch, scores, threshold, keep=extra)
        flagged = flagged.withColumn("score_version", F.lit(version))
        flagged.write.mode("overwrite").parquet(f"{path}/{FLAGGED}/batch={number}")

    extra = [name for name in orders.columns if name not in flags.ORDER_COLUMNS]
    with flags.state_on_disk(orders.sparkSession):
        return _run(once(orders, delay).writeStream.foreachBatch(write), checkpoint)


def _run(writer: DataStreamWriter, checkpoint: str) -> list[dict]:
    """Work off what is there and stop; the progress of the batches."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return [dict(progress) for progress in query.recentProgress]


def take_in(
    orders: DataFrame, columns: str, path: str, scores_path: str, delay: str
) -> tuple[list[dict], list[dict]]:
    """Both streams over what has arrived, one after the other."""
    spark = orders.sparkSession
    first = receive(orders, path, f"{path}/_receive", delay)
    rows = accepted(spark, path, columns)
    return first, flag_accepted(rows, path, scores_path, f"{path}/_flag", delay)


def accounts(spark: SparkSession, path: str, columns: str, by: list[str]) -> DataFrame:
    """What became of all delivered rows, by columns that orders carry.

    ``received`` = ``late`` + ``flagged`` + ``repeated``.
    """
    received = read_parquet(spark, f"{path}/{RECEIVED}", f"{columns}, batch int, late int")
    counts = received.groupBy(*by).agg(
        F.count("*").alias("received"), F.sum("late").cast("bigint").alias("late")
    )
    kinds = "score double, is_high_risk int, score_version string, batch int"
    flagged = read_parquet(spark, f"{path}/{FLAGGED}", f"{columns}, {kinds}")
    done = flagged.groupBy(*by).agg(
        F.count("*").alias("flagged"), F.sum("is_high_risk").cast("bigint").alias("high_risk")
    )
    none = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    repeated = F.col("received") - F.col("late") - F.coalesce("flagged", F.lit(0))
    same = [F.col(f"c.{name}").eqNullSafe(F.col(f"d.{name}")) for name in by]
    return counts.alias("c").join(done.alias("d"), same, "left").select(
        *[F.col(f"c.{name}").alias(name) for name in by], "received", "late", none("flagged"), repeated.alias("repeated"), none("high_risk")
    )
