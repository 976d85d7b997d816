"""The trees of a stored forest as a table: scores by joins down the levels, and checks of the fit.

The stored model keeps one row per node: split feature and threshold, children, weights of the classes,
impurity. With these rows a customer's score is a matter of joins: start at every tree's root, step to the
left or right child until a leaf is met, and average the leaves' shares of bad payers. That is plain SQL,
so scores and reports can be computed, and checked, where the model class cannot be loaded.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import labels as L

NODES = (
    "tree int, node int, feature int, threshold double, left_child int, right_child int, "
    "weight_0 double, weight_1 double, n_rows bigint, impurity double, gain double"
)


def node_table(spark: SparkSession, model_path: str) -> DataFrame:
    """One row per node of the forest stored under ``model_path``; leaves have no ``feature``.

    ``weight_0`` and ``weight_1`` are the weights of good and bad payers among the node's sampled training
    rows, ``n_rows`` is their number. There are at most trees x 2^(depth + 1) rows.
    """
    # The forest is the second stage of the pipeline, after the one that assembles the features.
    stored = spark.read.parquet(f"{model_path}/stages/1_*/data")
    nodes = stored.selectExpr(
        "treeID AS tree",
        "nodeData.id AS node",
        "nodeData.split.featureIndex AS feature",
        "get(nodeData.split.leftCategoriesOrThreshold, 0) AS threshold",
        "nodeData.leftChild AS left_child",
        "nodeData.rightChild AS right_child",
        "nodeData.impurityStats[0] AS weight_0",
        "nodeData.impurityStats[1] AS weight_1",
        "nodeData.rawCount AS n_rows",
        # Leaves that were never up for a split have -1.
        "CASE WHEN nodeData.impurity >= 0 THEN nodeData.impurity END AS impurity",
        "nodeData.gain AS gain",
    )
    inner = F.col("left_child") >= 0
    return nodes.withColumns(
        {name: F.when(inner, F.col(name))
         for name in ("feature", "threshold", "left_child", "right_child", "gain")}
    )


def walk(nodes: DataFrame, frame: DataFrame, features: Sequence[str] = L.FEATURES) -> DataFrame:
    """(user_id, score): the mean over all trees of the share of bad payers in the customer's leaf.

    ``nodes`` has the columns of :func:`node_table` and is broadcast at each level: it is bounded by the number
    of trees and their depth. A customer is one narrow row per tree on the way down; these rows do not move
    until their mean is taken, and are summed up before they do.
    """
    inner = F.broadcast(
        nodes.where("feature IS NOT NULL").select("tree", "node", "feature", "threshold", "left_child", "right_child")
    )
    shares = F.col("weight_1") / (F.col("weight_0") + F.col("weight_1"))
    leaves = nodes.where("feature IS NULL").select("tree", "node", shares.alias("share"))
    last = nodes.agg(F.max("tree")).first()[0]  # trees are numbered from 0
    values = F.array(*[F.col(name).cast("double") for name in features]).alias("x")
    every = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("tree")
    at = frame.select("user_id", values, every).withColumn("node", F.lit(0))
    for _ in range(depth(nodes)):
        value = F.element_at("x", F.col("feature") + 1)
        child = F.when(value <= F.col("threshold"), F.col("left_child")).otherwise(F.col("right_child"))
        at = at.join(inner, ["tree", "node"], "left").select(
            "user_id", "x", "tree", F.coalesce(child, F.col("node")).alias("node")
        )
    met = at.join(F.broadcast(leaves), ["tree", "node"])
    return met.groupBy("user_id").agg(F.avg("share").alias("score"))


def depth(nodes: DataFrame) -> int:
    """Levels below the roots, found by following the children; one small job per level."""
    level, below = nodes.where("node = 0").select("tree", "node"), 0
    pairs = nodes.where("feature IS NOT NULL").select(
        F.col("tree").alias("t"), F.col("node").alias("parent"),
        F.explode(F.array("left_child", "right_child")).alias("child"),
    )
    while True:
        down = level.join(pairs, F.expr("tree = t AND node = parent"))
        level = down.select("tree", F.col("child").alias("node"))
        if not level.limit(1).count():
            return below
        below += 1


def fit_checks(nodes: DataFrame, trees: int, min_leaf: int) -> DataFrame:
    """One row: what a fitted forest must satisfy, each as the number of nodes that break it.

    - ``wrong_trees``: difference from the number of trees asked for.
    - ``orphans``: nodes other than roots that are not the child of exactly one node.
    - ``small_nodes``: children with fewer sampled rows than a leaf may have.
    - ``lost_rows``, ``lost_weight``: splits whose children do not add up to them.
    - ``wrong_impurity``: Gini impurities that do not follow from the weights of the classes, or splits without.
    - ``wrong_gain``: gains that are not the drop of the impurity from a node to its children.
    - ``useless_splits``: splits that gain nothing.
    - ``unknown_features``: splits on something that is not a feature.
    """
    total = F.col("weight_0") + F.col("weight_1")
    gini = 1 - F.pow(F.col("weight_0") / total, 2) - F.pow(F.col("weight_1") / total, 2)
    known = nodes.withColumns({"total": total, "gini": gini})
    child = known.select("tree", F.col("node").alias("child"), "total", "gini", "n_rows", "weight_0", "weight_1")
    inner = known.where("feature IS NOT NULL").alias("p")
    left, right = child.alias("l"), child.alias("r")
    splits = inner.join(left, F.expr("p.tree = l.tree AND p.left_child = l.child")).join(
        right, F.expr("p.tree = r.tree AND p.right_child = r.child")
    )
    wrong = lambda a, b: F.count_if(F.abs(a - b) > 1e-6 * F.greatest(F.abs(a), F.lit(1.0)))
    after = F.expr("(l.total * l.gini + r.total * r.gini) / p.total")
    of_splits = splits.agg(
        F.count_if(F.expr("p.n_rows != l.n_rows + r.n_rows")).alias("lost_rows"),
        (
            wrong(F.col("p.weight_0"), F.col("l.weight_0") + F.col("r.weight_0"))
            + wrong(F.col("p.weight_1"), F.col("l.weight_1") + F.col("r.weight_1"))
        ).alias("lost_weight"),
        wrong(F.col("p.gain"), F.col("p.impurity") - after).alias("wrong_gain"),
        F.count_if(F.col("p.gain") <= 0).alias("useless_splits"),
        F.count_if(F.expr(f"least(l.n_rows, r.n_rows) < {min_leaf}")).alias("small_nodes"),
        F.count("*").alias("n_splits"),
    )
    of_nodes = known.agg(
        F.abs(F.count_distinct("tree") - F.lit(trees)).alias("wrong_trees"),
        # Every split has two children, so all nodes but the roots are children once.
        (F.count("*") - F.count_if(F.col("node") == 0)).alias("n_below"),
        (
            wrong(F.col("impurity"), F.col("gini"))
            + F.count_if(F.col("impurity").isNull() & F.col("feature").isNotNull())
        ).alias("wrong_impurity"),
        F.count_if(~F.col("feature").between(0, len(L.FEATURES) - 1)).alias("unknown_features"),
    )
    # Both are one row.
    met = of_nodes.withColumn("one", F.lit(1)).join(of_splits.withColumn("one", F.lit(1)), "one")
    return met.select(
        F.col("wrong_trees").cast("bigint"), F.abs(F.col("n_below") - 2 * F.col("n_splits")).alias("orphans"),
        "small_nodes", "lost_rows", "lost_weight", "wrong_impurity", "wrong_gain", "useless_splits",
        "unknown_features",
    )
