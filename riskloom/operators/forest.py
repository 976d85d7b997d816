"""The risk model: a class-weighted random forest, kept together with its threshold."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import labels as L
from riskloom.operators import trees
from riskloom.operators.split import stratified_split, with_class_weights
from riskloom.session import durable
from riskloom.sources import publication


def check_features(frame: DataFrame) -> None:
    """Fail with the columns that lack values, before the fit does so without naming them."""
    gaps = frame.agg(
        *(F.count_if(F.col(name).isNull() | F.isnan(F.col(name).cast("double"))).alias(name)
          for name in (*L.FEATURES, L.TARGET))
    ).first()
    missing = {name: n for name, n in gaps.asDict().items() if n}
    if missing:
        listed = ", ".join(f"{name} in {n} rows" for name, n in missing.items())
        raise ValueError(f"customers without a value cannot be trained on: {listed}")


def train(
    frame: DataFrame,
    trees: int = L.FOREST_TREES,
    depth: int = L.FOREST_DEPTH,
    min_leaf: int = L.FOREST_MIN_LEAF,
    seed: int = L.SEED,
) -> PipelineModel:
    """Fit the forest on a training frame; each class weighs the same in total."""
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=L.TARGET,
        weightCol="weight",
        numTrees=trees,
        maxDepth=depth,
        minInstancesPerNode=min_leaf,
        featureSubsetStrategy="sqrt",
        seed=seed,
    )
    check_features(frame)
    assembler = VectorAssembler(inputCols=L.FEATURES, outputCol="features", handleInvalid="error")
    return Pipeline(stages=[assembler, forest]).fit(with_class_weights(frame))


def score(model: PipelineModel, frame: DataFrame) -> DataFrame:
    """(user_id, y, score): the probability of being a bad payer beside the label."""
    return model.transform(frame).select(
        "user_id",
        F.col(L.TARGET).alias("y"),
        vector_to_array("probability")[1].alias("score"),
    )


def train_and_score(frame: DataFrame, **forest: int) -> tuple[PipelineModel, DataFrame]:
    """Split a training frame, train, and score the held-out customers.

    The split reads the frame twice, so a frame that is costly to compute should be stored. The
    split itself is stored because fitting reads it several times.
    """
    split = durable(stratified_split(frame))
    model = train(split.where("is_test = 0"), **forest)
    return model, score(model, split.where("is_test = 1"))


def save(
    model: PipelineModel, threshold: DataFrame, path: str, more: dict[str, DataFrame] | None = None
) -> str:
    """Publish the model and its threshold, and ``more`` tables about them, as one version.

    Returns the version. What was published before stays readable until it is retired.
    """
    spark = threshold.sparkSession
    best = threshold.select("threshold").first()
    if best is None or best["threshold"] is None:
        raise ValueError("no threshold: the held-out customers have no bad payer among them")
    version = publication.new_version(spark, path)
    model.write().save(f"{path}/model/{version}")
    for name, df in {"threshold": threshold.select("threshold"), **(more or {})}.items():
        df.write.parquet(f"{path}/{name}/{version}")
    publication.publish(spark, path, version)
    return version


def load(spark: SparkSession, path: str, version: str | None = None) -> tuple[PipelineModel, float]:
    """The model and threshold of the given version, or of the one published last."""
    version = version or publication.current(spark, path)
    model = PipelineModel.load(f"{path}/model/{version}")
    row = spark.read.schema("threshold double").parquet(f"{path}/threshold/{version}").first()
    if row is None or row["threshold"] is None:
        raise ValueError(f"the model under {path} was stored without a threshold")
    return model, row["threshold"]


def load_nodes(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """The trees of a version as a table, see :mod:`riskloom.operators.trees`."""
    version = version or publication.current(spark, path)
    return trees.node_table(spark, f"{path}/model/{version}")


def flag_customers(model: PipelineModel, threshold: float, frame: DataFrame) -> DataFrame:
    """Score a training or feature frame and flag the customers at or above the threshold."""
    scored = score(model, frame).drop("y")
    return scored.withColumn("is_high_risk", (F.col("score") >= threshold).cast("int"))
