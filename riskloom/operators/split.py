"""Training frame, stratified split and class weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import labels as L

# A row's hash has 60 bits; the highest 12 name its bucket, which makes 4096 buckets per class.
HASH_BITS = 60
BUCKET_BITS = 12


def training_frame(features: DataFrame) -> DataFrame:
    """Key, model features and target; the columns that give the target away are left out."""
    return features.select("user_id", *L.FEATURES, L.TARGET)


def stratified_split(
    frame: DataFrame,
    key: str = "user_id",
    label: str = L.TARGET,
    test_fraction: float = L.TEST_FRACTION,
    seed: int = L.SEED,
) -> DataFrame:
    """Add ``is_test``: an exact share of every class, chosen by a seeded hash of the unique key.

    The rank of a row within its class decides. Ranking a class as a whole would put it into one
    task, so rows are ranked within hash buckets and a small table of bucket sizes, at most
    classes x 4096 rows, supplies the number of rows in front of each bucket.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    hashed = frame.withColumn(
        "_hash", F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")
    ).withColumn("_bucket", F.shiftright("_hash", HASH_BITS - BUCKET_BITS))
    sizes = hashed.groupBy(label, "_bucket").agg(F.count("*").alias("_size"))

    of_class = Window.partitionBy(label)
    in_front = of_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        label, "_bucket", F.coalesce(F.sum("_size").over(in_front), F.lit(0)).alias("_before")
    )
    quotas = test_quotas(sizes.groupBy(label).agg(F.sum("_size").alias("n")), label, test_fraction)
    lookup = offsets.join(quotas.select(label, "n_test"), label)

    in_bucket = Window.partitionBy(label, "_bucket").orderBy("_hash", key)
    # Safe to broadcast: bounded by classes x buckets, whatever the number of rows.
    return (
        hashed.withColumn("_rank", F.row_number().over(in_bucket))
        .join(F.broadcast(lookup), [label, "_bucket"])
        .withColumn(
            "is_test", F.when(F.col("_before") + F.col("_rank") <= F.col("n_test"), 1).otherwise(0)
        )
        .select(*frame.columns, "is_test")
    )


def test_quotas(class_counts: DataFrame, label: str, test_fraction: float) -> DataFrame:
    """Test rows per class: proportional, largest remainders first, summing to the whole share.

    ``class_counts`` has one row (label, n) per class, so its windows need no partitions.
    """
    classes = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(classes)
    train_total = total - F.ceil(total * F.lit(test_fraction))
    # Doubles: the product outgrows a bigint at a few billion rows.
    exact = F.col("n").cast("double") * train_total / total
    return (
        class_counts.withColumn("_exact", exact)
        .withColumn("_floor", F.floor("_exact"))
        .withColumn("_left", train_total - F.sum("_floor").over(classes))
        .withColumn(
            "_place",
            F.row_number().over(classes.orderBy(F.desc(F.col("_exact") - F.col("_floor")), label)),
        )
        .withColumn(
            "n_train",
            F.col("_floor") + F.when(F.col("_place") <= F.col("_left"), 1).otherwise(0),
        )
        .select(label, "n", "n_train", (F.col("n") - F.col("n_train")).alias("n_test"))
    )


def class_weights(frame: DataFrame, label: str = L.TARGET) -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = frame.groupBy(label).agg(F.count("*").alias("n"))
    # One row per class from here on.
    classes = Window.partitionBy(F.lit(0))
    weight = F.sum("n").over(classes) / (F.count("*").over(classes) * F.col("n"))
    return counts.withColumn("weight", weight)


def with_class_weights(frame: DataFrame, label: str = L.TARGET) -> DataFrame:
    """Attach the balanced weight to every row."""
    weights = class_weights(frame, label).select(label, "weight")
    # Safe to broadcast: one row per class.
    return frame.join(F.broadcast(weights), label)
