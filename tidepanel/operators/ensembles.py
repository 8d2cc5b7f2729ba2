"""Fitted tree ensembles as tables of nodes: saved, read back, cut and scored in DataFrame operations."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, staged
from .learn import Fitted, fit_gbt

NODES = "tree int, weight double, node int, feature string, threshold double, left int, right int, value double, steps int"


def node_table(fitted: Fitted, spark: SparkSession) -> DataFrame:
    """One row per node: a leaf has no ``feature``; ``value`` is its mean, or the share of class 1 in a classifier.

    ``weight`` is the tree's in the sum that predicts, so a forest's trees have equal parts of 1. ``steps`` is the most
    decisions from a root to a leaf. The table is read from the model as Spark ML saves it, so no node passes the driver.
    """
    path = scratch_path(spark, "model")
    fitted.model.write().save(path)
    trees = spark.read.parquet(f"{path}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    if not isinstance(fitted.model, GBTRegressionModel):
        trees = trees.withColumn("weight", F.lit(1.0 / fitted.model.getNumTrees))
    n = spark.read.parquet(f"{path}/data").select(F.col("treeID").alias("tree"), "nodeData.*")
    stats = F.col("impurityStats")
    value = F.get(stats, F.lit(1)) / (F.get(stats, F.lit(0)) + F.get(stats, F.lit(1))) if isinstance(fitted.model, RandomForestClassificationModel) else F.col("prediction")
    inner = F.col("leftChild") >= 0
    nodes = n.join(trees, "tree").select(
        "tree", "weight", F.col("id").alias("node"),
        F.when(inner, F.get(F.array(*map(F.lit, fitted.cols)), F.col("split.featureIndex"))).alias("feature"),
        F.when(inner, F.get("split.leftCategoriesOrThreshold", F.lit(0))).alias("threshold"),
        F.when(inner, F.col("leftChild")).alias("left"), F.when(inner, F.col("rightChild")).alias("right"),
        value.alias("value"), F.lit(fitted.model.getOrDefault("maxDepth")).alias("steps"),
    )
    return staged(nodes, "nodes")


def save_nodes(nodes: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").parquet(path)


def load_nodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NODES).parquet(path)


def cut(nodes: DataFrame, trees: int) -> DataFrame:
    """The ensemble of the first ``trees`` trees."""
    return nodes.where(F.col("tree") < trees)


def with_tree_values(df: DataFrame, nodes: DataFrame, cols: list[str], name: str = "parts") -> DataFrame:
    """Add an array of what each tree adds to the prediction, in the order of the trees.

    The model, whose size its parameters bound, enters as one scalar. A missing feature value goes right, as any comparison with NaN does.
    """
    at = F.array_position(F.array(*map(F.lit, cols)), F.col("feature")) - 1
    # a leaf leads to itself on either side, so that a step reads its node three times and no more
    inner = at >= 0
    node = F.struct(
        "node", F.when(inner, at).otherwise(F.lit(0)).cast("int").alias("at"), "threshold",
        F.when(inner, F.col("left")).otherwise(F.col("node")).alias("left"), F.when(inner, F.col("right")).otherwise(F.col("node")).alias("right"), "value",
    )
    trees = nodes.groupBy("tree", "weight", "steps").agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    model = trees.agg(F.sort_array(F.collect_list(F.struct("tree", "weight", "steps", "nodes")))).scalar()

    def down(tree: Column, x: Column) -> Column:
        def step(here: Column, _: Column) -> Column:
            node = F.get(tree["nodes"], here)
            return F.when(F.get(x, node["at"]) <= node["threshold"], node["left"]).otherwise(node["right"])

        return F.get(tree["nodes"], F.aggregate(F.sequence(F.lit(1), tree["steps"]), F.lit(0), step))["value"]

    features = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols])
    # features and model are bound to a variable once a row, not built again at each node
    both = F.array(F.struct(features.alias("x"), F.col("_trees").alias("trees")))
    parts = F.get(F.transform(both, lambda b: F.transform(b["trees"], lambda tree: tree["weight"] * down(tree, b["x"]))), F.lit(0))
    return df.withColumn("_trees", model).withColumn(name, parts).drop("_trees")


@dataclass
class NodeModel:
    """A node table that predicts like the ensemble it came from."""

    nodes: DataFrame
    cols: list[str]

    def predict(self, df: DataFrame, name: str = "p") -> DataFrame:
        out = with_tree_values(df, self.nodes, self.cols, "_parts")
        return out.withColumn(name, F.aggregate("_parts", F.lit(0.0), lambda a, v: a + v)).drop("_parts")


def error_curve(df: DataFrame, nodes: DataFrame, cols: list[str], y: str = "y") -> DataFrame:
    """``(trees, n, rmse)`` of every prefix of the ensemble, from one pass over ``df``.

    Each row's contributions are summed up tree by tree; a task emits one sum of squares per prefix.
    """
    rows = with_tree_values(df.where(F.col(y).isNotNull()), nodes, cols, "_parts").select(F.col(y).cast("double").alias("y"), F.col("_parts").alias("parts"))

    def sums(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                parts = batch.column("parts").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                gap = np.cumsum(parts, axis=1) - batch.column("y").to_numpy(zero_copy_only=False)[:, None]
                squares = (gap * gap).sum(axis=0)
                total, n = squares if total is None else total + squares, n + batch.num_rows
        if n:
            k = len(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, k + 1), pa.int32()), pa.array(np.full(k, n), pa.int64()), pa.array(total)], ["trees", "n", "sse"])

    per = rows.mapInArrow(sums, "trees int, n long, sse double").groupBy("trees").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"))
    return per.select("trees", "n", F.sqrt(F.col("sse") / F.col("n")).alias("rmse"))


def best_prefix(curve: DataFrame, patience: int = 100) -> int:
    """Trees up to the least error that is found before ``patience`` trees in a row have brought none lower."""
    best, at = float("inf"), 0
    for row in curve.orderBy("trees").collect():  # one row per tree
        if row["rmse"] < best:
            best, at = row["rmse"], row["trees"]
        elif row["trees"] - at >= patience:
            break
    return at


def fit_patient(df: DataFrame, cols: list[str], valid: Column, y: str = "y", patience: int = 100, **params) -> tuple[NodeModel, DataFrame]:
    """Boosted trees fitted where ``valid`` is false and cut to the prefix that predicts best where it is true, and the error curve."""
    spark = df.sparkSession
    nodes = node_table(fit_gbt(df.where(~valid), cols, y, **params), spark)
    curve = staged(error_curve(df.where(valid), nodes, cols, y), "curve")
    return NodeModel(cut(nodes, max(1, best_prefix(curve, patience))), cols), curve
