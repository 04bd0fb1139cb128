"""Boosted trees and random forests on a panel: fit, score, importances, scores per tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.session import scratch_path, shared_dir, stored

MAX_DEPTH = 30
# Rows that one task holds while trees are fitted: Spark ML keeps them as points, wider than in the files that they come from.
FIT_ROWS = 500_000


def tree_params(params: dict) -> dict:
    """Spark ML parameters for the names a parameter search uses.

    Spark grows trees by level, so a leaf count becomes the smallest depth that can hold it.
    """
    out = {}
    if "num_leaves" in params:
        depth = max(1, math.ceil(math.log2(params["num_leaves"])))
        if depth > MAX_DEPTH:
            raise ValueError(f"num_leaves needs depth {depth}; trees have {MAX_DEPTH} levels at most")
        out["maxDepth"] = depth
    if "min_data_in_leaf" in params:
        out["minInstancesPerNode"] = int(params["min_data_in_leaf"])
    if "feature_fraction" in params:
        out["featureSubsetStrategy"] = str(float(params["feature_fraction"]))
    if "bagging_fraction" in params:
        out["subsamplingRate"] = float(params["bagging_fraction"])
    if "min_split_gain" in params:
        out["minInfoGain"] = float(params["min_split_gain"])
    if "max_bin" in params:
        out["maxBins"] = int(params["max_bin"])
    return out


def assemble(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """Feature vector next to the kept columns; the id and the period are never features."""
    rows = df.select(*keep, *[F.col(c).cast("double").alias(f"_f_{c}") for c in features])
    maker = VectorAssembler(inputCols=[f"_f_{c}" for c in features], outputCol="features")
    return maker.transform(rows).select(*keep, "features")


def _spread(train: DataFrame) -> DataFrame:
    """Training rows in as many tasks as they need; files that hold few bytes a row would give tasks of very many rows."""
    tasks = -(-train.count() // FIT_ROWS)
    return train.repartition(tasks) if tasks > train.rdd.getNumPartitions() else train


def fit_boosted(
    train: DataFrame,
    target: str,
    weight: str | None,
    rounds: int,
    learning_rate: float = 0.1,
    params: dict | None = None,
    seed: int = 42,
    validation: str | None = None,
    tolerance: float = 0.01,
) -> GBTClassificationModel:
    """Boosted trees on assembled rows; the lineage of the rounds is cut in the shared folder.

    With `validation`, a boolean column, its rows are not learned from, and rounds end when they
    no longer improve the error on those rows by `tolerance`.
    """
    shared_dir(train.sparkSession)
    gbt = GBTClassifier(
        featuresCol="features",
        labelCol=target,
        maxIter=rounds,
        stepSize=learning_rate,
        seed=seed,
        cacheNodeIds=True,
        checkpointInterval=10,
        **tree_params(params or {}),
    )
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
        gbt = gbt.copy({gbt.validationTol: tolerance})
    return gbt.fit(_spread(train.withColumn(target, F.col(target).cast("double"))))


def fit_forest(
    train: DataFrame,
    target: str,
    weight: str | None,
    trees: int,
    params: dict | None = None,
    seed: int = 42,
):
    shared_dir(train.sparkSession)
    forest = RandomForestClassifier(
        featuresCol="features",
        labelCol=target,
        numTrees=trees,
        seed=seed,
        **tree_params(params or {}),
    )
    if weight:
        forest = forest.setWeightCol(weight)
    return forest.fit(_spread(train.withColumn(target, F.col(target).cast("double"))))


def predict(model: Model, rows: DataFrame, keep: list[str], out: str = "pred") -> DataFrame:
    """Probability of the positive class of every row."""
    return model.transform(rows).select(
        *keep, vector_to_array("probability").getItem(1).alias(out)
    )


def importances(
    spark: SparkSession, model: Model, features: list[str], number: int = 0
) -> DataFrame:
    """Importance of every feature of one model; one row per feature."""
    values = model.featureImportances.toArray()
    rows = [(f, float(v), number) for f, v in zip(features, values)]
    return spark.createDataFrame(
        rows, "fname_model string, fimportance_model double, model int"
    )


def split_counts(
    model: Model, features: list[str], spark: SparkSession, number: int = 0, by_depth: bool = False
) -> DataFrame:
    """How many splits of one model use every feature, zero for unused ones: another importance than the gain.

    Counted over the saved nodes. With `by_depth` one row per feature and depth (from 0) at which the model has any
    split. Columns: fname_model, splits, model, and depth. Use it as `fimportance_model` of `importances`.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    node = F.col("nodeData")
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"),
    )

    def depths(nodes: pa.Table) -> pa.Table:
        """Splits of one tree by feature and depth; `nodes` are its inner nodes."""
        rows = {r["id"]: r for r in nodes.select(["id", "feature", "left", "right"]).to_pylist()}
        children = {c for r in rows.values() for c in (r["left"], r["right"])}
        level, depth, counts = [i for i in rows if i not in children], 0, {}
        while level:
            for i in level:
                key = (rows[i]["feature"], depth)
                counts[key] = counts.get(key, 0) + 1
            level = [c for i in level for c in (rows[i]["left"], rows[i]["right"]) if c in rows]
            depth += 1
        return pa.table(
            {
                "feature": pa.array([k[0] for k in counts], pa.int32()),
                "depth": pa.array([k[1] for k in counts], pa.int32()),
                "splits": pa.array(list(counts.values()), pa.int64()),
            }
        )

    inner = nodes.where(F.col("left") >= 0)
    names = spark.createDataFrame(list(enumerate(features)), "feature int, fname_model string")
    if not by_depth:
        counts = inner.groupBy("feature").agg(F.count(F.lit(1)).alias("splits"))
        keys = names
    else:
        counts = inner.groupBy("tree").applyInArrow(depths, "feature int, depth int, splits long")
        counts = counts.groupBy("feature", "depth").agg(F.sum("splits").alias("splits"))
        counts = stored(counts, "splits")  # features x depths rows
        keys = names.crossJoin(counts.select("depth").distinct())
    joined = keys.join(counts, [c for c in ("feature", "depth") if c in keys.columns], "left")
    depth = ["depth"] if by_depth else []
    return joined.select(
        "fname_model", *depth, F.coalesce("splits", F.lit(0)).cast("long").alias("splits"), F.lit(number).alias("model")
    )


def tree_tables(model: GBTClassificationModel, spark: SparkSession) -> list[tuple[np.ndarray, ...]]:
    """(feature, threshold, left, right, prediction) of the nodes of every tree, weighted.

    Read from the saved model, which is as large as the model. Leaves have feature -1. Splits are on numbers.
    """
    path = scratch_path(spark, "model")
    model.write().save(path)
    node = F.col("nodeData")
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["split"]["featureIndex"].alias("feature"),
        F.get(node["split"]["leftCategoriesOrThreshold"], F.lit(0)).alias("threshold"),
        node["split"]["numCategories"].alias("categories"),
        node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["prediction"].alias("prediction"),
    ).toPandas().sort_values(["treeID", "id"])
    if (rows.categories > 0).any():
        raise ValueError("scores per round need trees over numbers, not categories")
    out = []
    for number, tree in rows.groupby("treeID"):
        leaf = tree.left.to_numpy() < 0
        out.append(
            (
                np.where(leaf, -1, tree.feature.to_numpy()),
                tree.threshold.fillna(0.0).to_numpy(),
                tree.left.to_numpy(),
                tree.right.to_numpy(),
                tree.prediction.to_numpy() * model.treeWeights[number],
            )
        )
    return out


def scores_per_round(
    model: GBTClassificationModel, rows: DataFrame, keep: list[str], out: str = "margin", every: int = 1
) -> DataFrame:
    """Every row once per `every` boosting rounds and for the last, with the margin up to that round.

    The trees are sent to the tasks as arrays and walked for whole batches, so the plan does not
    grow with the rounds.
    """
    trees = tree_tables(model, rows.sparkSession)
    wanted = sorted({*range(every, len(trees) + 1, every), len(trees)})
    shared = rows.sparkSession.sparkContext.broadcast(trees)
    numbers = rows.select(*keep, vector_to_array("features").alias("_x"))
    kinds = T.StructType([*rows.select(*keep).schema.fields, T.StructField("_margins", T.ArrayType(T.DoubleType()))])

    def walk(batches):
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            margin, found = np.zeros(batch.num_rows), []
            for i, (feature, threshold, left, right, prediction) in enumerate(shared.value, 1):
                at = np.zeros(batch.num_rows, np.int64)
                while batch.num_rows:
                    inner = np.flatnonzero(feature[at] >= 0)
                    if not len(inner):
                        break
                    node = at[inner]
                    below = x[inner, feature[node]] <= threshold[node]
                    at[inner] = np.where(below, left[node], right[node])
                margin = margin + prediction[at]
                if i in wanted:
                    found.append(margin)
            margins = pa.array(list(np.column_stack(found)) if batch.num_rows else [], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], margins], names=[*keep, "_margins"])

    scored = numbers.mapInArrow(walk, kinds)
    rounds = F.array(*[F.lit(i) for i in wanted])
    return scored.select(*keep, F.posexplode("_margins").alias("_place", out)).select(
        *keep, F.get(rounds, F.col("_place")).alias("iteration"), out
    )
