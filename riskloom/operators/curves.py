"""Exact ranking metrics for any frame with a score and a 0/1 label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import labels as L
from riskloom.session import durable


def score_points(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Positives and negatives at every distinct score."""
    return scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("bigint")).alias("pos"),
        F.sum((1 - F.col(label)).cast("bigint")).alias("neg"),
    )


def pr_curve(scored: DataFrame, score: str = "score", label: str = "y") -> DataFrame:
    """Precision, recall and F1 of ``score >= threshold`` at every distinct score.

    The running totals need no global window. Distinct scores are range-partitioned, which
    balances them however scores cluster, and stored with the number of their partition. Sums
    run inside a partition; a table with one row per partition adds what lies in front of it.
    """
    ranged = score_points(scored, score, label).repartitionByRange(F.desc("score"))
    points = durable(ranged.withColumn("block", F.spark_partition_id()))

    blocks = points.groupBy("block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # Windows over one row per partition.
    in_front = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    offsets = blocks.select(
        "block",
        F.coalesce(F.sum("pos").over(in_front), F.lit(0)).alias("pos_before"),
        F.coalesce(F.sum("neg").over(in_front), F.lit(0)).alias("neg_before"),
        F.sum("pos").over(everything).alias("all_pos"),
        F.sum("neg").over(everything).alias("all_neg"),
    )
    so_far = (
        Window.partitionBy("block")
        .orderBy(F.desc("score"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    precision = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    recall = F.try_divide(F.col("tp"), F.col("all_pos"))
    # Safe to broadcast: one row per partition.
    return (
        points.join(F.broadcast(offsets), "block")
        .withColumn("tp", F.col("pos_before") + F.sum("pos").over(so_far))
        .withColumn("fp", F.col("neg_before") + F.sum("neg").over(so_far))
        .select(
            "score",
            "pos",
            "neg",
            "tp",
            "fp",
            "all_pos",
            "all_neg",
            precision.alias("precision"),
            recall.alias("recall"),
        )
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))
    )


def _f1(precision: Column, recall: Column) -> Column:
    return 2 * precision * recall / (precision + recall + F.lit(L.F1_EPSILON))


def _average_precision() -> Column:
    gain = F.try_divide(F.col("pos"), F.col("all_pos"))
    return F.sum(gain * F.col("precision"))


def _roc_auc() -> Column:
    # Doubles: the number of pairs outgrows a bigint at a few billion rows of each class.
    outranked = F.col("neg").cast("double") * (F.col("tp") - F.col("pos") / 2)
    pairs = F.max("all_pos").cast("double") * F.max("all_neg")
    return F.try_divide(F.sum(outranked), pairs)


def average_precision(curve: DataFrame) -> DataFrame:
    """Precision weighted by the gain in recall; unknown without positives."""
    return curve.agg(_average_precision().alias("average_precision"))


def roc_auc(curve: DataFrame) -> DataFrame:
    """Chance that a positive outranks a negative, ties counting half; unknown for one class."""
    return curve.agg(_roc_auc().alias("roc_auc"))


def best_f1_threshold(curve: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest of equals."""
    return (
        curve.where(F.col("f1").isNotNull())
        .orderBy(F.desc("f1"), "score")
        .limit(1)
        .select(F.col("score").alias("threshold"), "f1", "precision", "recall")
    )


def summary(curve: DataFrame) -> DataFrame:
    """ROC AUC, average precision, best threshold and its F1 in one pass over the curve."""
    best = F.max(F.struct("f1", (-F.col("score")).alias("minus_score")))
    return curve.agg(
        _roc_auc().alias("roc_auc"), _average_precision().alias("average_precision"),
        best.alias("best"),
    ).select(
        "roc_auc",
        "average_precision",
        (-F.col("best.minus_score")).alias("threshold"),
        F.col("best.f1").alias("f1"),
    )
