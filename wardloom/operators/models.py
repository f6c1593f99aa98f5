"""Boosted trees and vector heads: fit, score, history, best iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    MultilayerPerceptronClassificationModel,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.operators import boosting
from wardloom.operators.metrics import staged_auc
from wardloom.sources.sinks import materialized, new_location


# A further tree must lower the validation error by this share of it, or fitting stops.
VALIDATION_TOLERANCE = 0.01
_HELD = "_held_out"


def fit_mortality(train: DataFrame, label: str = "hospital_expire_flag", features: str = "features",
                  trees: int = lookups.BOOSTING_TREES, depth: int = lookups.BOOSTING_DEPTH,
                  rate: float = lookups.BOOSTING_RATE, seed: int = lookups.SEED,
                  validation: DataFrame | None = None, tolerance: float = VALIDATION_TOLERANCE,
                  written: bool = False) -> GBTClassificationModel:
    """Boosted-tree classifier for a 0/1 label.

    With ``validation`` rows no tree is fitted beyond the one after which their
    error stops falling, and the model ends with the best one. Rows of a
    ``written`` table are read again instead of kept.
    """
    estimator = GBTClassifier(
        labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
        maxMemoryInMB=512,
    )
    return _boosted(estimator, *_inputs(label, features, train, validation), tolerance, written)


def _inputs(label: str, features: str, *parts: DataFrame | None) -> list[DataFrame | None]:
    return [p if p is None else p.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias(label), features) for p in parts]


def _boosted(estimator, inputs: DataFrame, validation: DataFrame | None, tolerance: float, written: bool):
    """Fit trees on inputs that are on disk: fitting reads them several times."""
    if validation is not None:
        inputs = inputs.withColumn(_HELD, F.lit(False)).unionByName(validation.withColumn(_HELD, F.lit(True)))
        estimator = estimator.copy({estimator.validationIndicatorCol: _HELD, estimator.validationTol: tolerance})
    kept = inputs if written else inputs.persist(StorageLevel.DISK_ONLY)
    try:
        return boosting.fit(estimator, kept, None if validation is None else _HELD)
    finally:
        if not written:
            kept.unpersist()


def _fit(estimator, inputs: DataFrame):
    """Fit on kept inputs: fitting passes over them several times."""
    kept = inputs.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return estimator.fit(kept)
    finally:
        kept.unpersist()


def score_mortality(model: GBTClassificationModel, df: DataFrame) -> DataFrame:
    """Add ``prob`` of label 1 and the predicted class (``pred``)."""
    scored = model.transform(df)
    return scored.select(
        *df.columns,
        vector_to_array(F.col(model.getProbabilityCol()))[1].alias("prob"),
        F.col(model.getPredictionCol()).cast("int").alias("pred"),
    )


def fit_stay(train: DataFrame, label: str = "los_days", features: str = "features",
             trees: int = lookups.BOOSTING_TREES, depth: int = lookups.BOOSTING_DEPTH,
             rate: float = lookups.BOOSTING_RATE, seed: int = lookups.SEED,
             validation: DataFrame | None = None, tolerance: float = VALIDATION_TOLERANCE,
             written: bool = False) -> GBTRegressionModel:
    """Boosted-tree regressor; rows without a known value are not trained on, nor measured if ``validation`` ends the fit."""
    estimator = GBTRegressor(
        labelCol=label, featuresCol=features, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed,
        maxMemoryInMB=512,
    )
    return _boosted(estimator, *_inputs(label, features, train, validation), tolerance, written)


def score_stay(model: GBTRegressionModel, df: DataFrame, name: str = "los_pred") -> DataFrame:
    return model.transform(df).withColumnRenamed(model.getPredictionCol(), name)


def fit_vector_classifier(train: DataFrame, vector: str, label: str, classes: int,
                          width: int = lookups.HEAD_WIDTH, iterations: int = 100,
                          seed: int = lookups.SEED) -> MultilayerPerceptronClassificationModel:
    """One-hidden-layer head on a fixed array-of-float column."""
    inputs = train.select(array_to_vector(F.col(vector)).alias("features"), F.col(label).cast("double").alias("label"))
    size = len(train.select(vector).first()[0])
    estimator = MultilayerPerceptronClassifier(
        layers=[size, width, classes], maxIter=iterations, seed=seed, blockSize=128
    )
    return _fit(estimator, inputs)


def score_vectors(model, df: DataFrame, vector: str, name: str = "pred") -> DataFrame:
    """Add the prediction of a fitted vector head; a classifier adds ``prob`` of class 1 too."""
    out = model.transform(df.withColumn("features", array_to_vector(F.col(vector))))
    columns = [*df.columns, F.col("prediction").alias(name)]
    if isinstance(model, MultilayerPerceptronClassificationModel):
        columns.append(vector_to_array(F.col("probability"))[1].alias("prob"))
    return out.select(*columns)


def fit_vector_regressor(train: DataFrame, vector: str, label: str, trees: int = lookups.BOOSTING_TREES,
                         seed: int = lookups.SEED) -> GBTRegressionModel:
    """Regression head on a fixed array-of-float column."""
    inputs = train.select(array_to_vector(F.col(vector)).alias("features"), label)
    return fit_stay(inputs, label, "features", trees=trees, seed=seed)


# --- per-iteration history ---------------------------------------------------


@dataclass
class TreeTable:
    """The nodes of all trees, end to end; a leaf is its own child."""

    used: list[int]  # features that any tree looks at
    roots: np.ndarray
    column: np.ndarray  # place of the node's feature in ``used``
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # prediction times the tree's weight
    depth: int

    def staged(self, rows: np.ndarray) -> np.ndarray:
        """Running sum of the trees for each row: one column per iteration."""
        out = np.empty((len(rows), len(self.roots)))
        every = np.arange(len(rows))
        for i, root in enumerate(self.roots.tolist()):
            node = np.full(len(rows), root)
            for _ in range(self.depth):
                low = rows[every, self.column[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            out[:, i] = self.value[node]
        return np.cumsum(out, axis=1)


def tree_table(model: GBTClassificationModel | GBTRegressionModel, spark: SparkSession, trees: int | None = None) -> TreeTable:
    """Nodes of a fitted model (its first ``trees``), read from the model's own saved form."""
    location = new_location(spark, "trees")
    model.save(location)
    nodes = spark.read.parquet(f"{location}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    weights = list(model.treeWeights)[:trees]
    nodes = [n for n in nodes if n["treeID"] < len(weights)]
    used = sorted({n["split"]["featureIndex"] for n in nodes if n["leftChild"] >= 0}) or [0]
    place = {f: i for i, f in enumerate(used)}
    first: dict[int, int] = {}
    for i, n in enumerate(nodes):
        first.setdefault(n["treeID"], i)
    inner = [n["leftChild"] >= 0 for n in nodes]
    child = lambda side: np.array([first[n["treeID"]] + n[side] if k else i for i, (n, k) in enumerate(zip(nodes, inner))])
    return TreeTable(
        used, np.array([first[t] for t in range(len(weights))]),
        np.array([place[n["split"]["featureIndex"]] if k else 0 for n, k in zip(nodes, inner)]),
        np.array([n["split"]["leftCategoriesOrThreshold"][0] if k else 0.0 for n, k in zip(nodes, inner)]),
        child("leftChild"), child("rightChild"), np.array([n["prediction"] * weights[n["treeID"]] for n in nodes]),
        max(t.depth for t in model.trees),
    )


def staged_outputs(model: GBTClassificationModel | GBTRegressionModel, df: DataFrame, name: str = "staged",
                   trees: int | None = None) -> DataFrame:
    """Add the running weighted sum of the trees, one entry per iteration.

    All trees score a batch of rows in one step; only the features that they
    look at leave the JVM.
    """
    table = tree_table(model, df.sparkSession, trees)
    known = df.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("array<double>")
    def running(batch: pa.Array) -> pa.Array:
        width = len(known.value.used)
        sums = known.value.staged(batch.flatten().to_numpy().reshape(-1, width))
        offsets = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * sums.shape[1])
        return pa.ListArray.from_arrays(offsets, pa.array(sums.ravel()))

    sliced = VectorSlicer(inputCol=model.getFeaturesCol(), outputCol="_sliced", indices=table.used).transform(df)
    return sliced.select(*df.columns, running(vector_to_array("_sliced")).alias(name))


# Losses of a matrix of running sums (a column for each iteration) against a column of labels.
Loss = Callable[[np.ndarray, np.ndarray], np.ndarray]


def log_losses(label: np.ndarray, margin: np.ndarray) -> np.ndarray:
    """log(1 + exp(-x)) without overflow, for the margin's sign as the label wants it."""
    x = 2.0 * margin * np.where(label == 1, 1.0, -1.0)
    return np.log1p(np.exp(-np.abs(x))) + np.maximum(-x, 0.0)


def square_losses(label: np.ndarray, value: np.ndarray) -> np.ndarray:
    return (label - value) ** 2


def size_losses(label: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.abs(label - value)


def _mean_by_iteration(staged: DataFrame, losses: dict[str, Loss], label: str, iterations: int, name: str = "staged") -> DataFrame:
    """``iteration`` and the mean of each loss over the rows with a label; a task sends one array of sums."""
    size = iterations * len(losses)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(size), 0
        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)[:, None]
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, iterations)
            sums += np.concatenate([loss(y, values).sum(axis=0) for loss in losses.values()])
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["sums", "n"])

    known = staged.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), name)
    parts = known.mapInArrow(run, "sums array<double>, n long").select("n", F.posexplode("sums").alias("place", "value"))
    place = (F.col("place") % iterations + 1).alias("iteration")
    means = {k: F.try_divide(F.sum(F.when(F.floor(F.col("place") / iterations) == i, F.col("value"))),
                             F.sum(F.when(F.floor(F.col("place") / iterations) == i, F.col("n")))) for i, k in enumerate(losses)}
    return parts.groupBy(place).agg(*[v.alias(k) for k, v in means.items()])


def margin_probability(margin: Column) -> Column:
    """Boosted log-odds margin to the probability of label 1."""
    return 1.0 / (1.0 + F.exp(-2.0 * margin))


def _staged_table(model: GBTClassificationModel | GBTRegressionModel, df: DataFrame, label: str) -> DataFrame:
    """Label and running sums, written once and read by every measure."""
    return materialized(staged_outputs(model, df).select(label, "staged"), "staged")


def mortality_history(model: GBTClassificationModel, train: DataFrame, val: DataFrame,
                      label: str = "hospital_expire_flag") -> DataFrame:
    """``iteration, train_loss, val_loss, val_auc`` for every iteration."""
    n = model.getNumTrees
    held = _staged_table(model, val, label)
    train_loss = _mean_by_iteration(_staged_table(model, train, label), {"train_loss": log_losses}, label, n)
    val_loss = _mean_by_iteration(held, {"val_loss": log_losses}, label, n)
    ranked = held.withColumn("staged", F.transform("staged", margin_probability))
    val_auc = staged_auc(ranked, label, n).withColumnRenamed("auc_roc", "val_auc")
    return train_loss.join(val_loss, "iteration").join(val_auc, "iteration").orderBy("iteration")


def stay_history(model: GBTRegressionModel, train: DataFrame, val: DataFrame,
                 label: str = "los_days") -> DataFrame:
    """``iteration, train_loss, val_loss, val_mae`` for every iteration."""
    n = model.getNumTrees
    train_loss = _mean_by_iteration(_staged_table(model, train, label), {"train_loss": square_losses}, label, n)
    held = _mean_by_iteration(_staged_table(model, val, label), {"val_loss": square_losses, "val_mae": size_losses}, label, n)
    return train_loss.join(held, "iteration").orderBy("iteration")


def best_iteration(history: DataFrame, series: str, largest: bool, groups: tuple[str, ...] = ()) -> DataFrame:
    """Iteration with the best value of a series; the earliest one wins ties."""
    if largest:
        chosen = F.max_by("iteration", F.struct(F.col(series), -F.col("iteration")))
        value = F.max(series)
    else:
        chosen = F.min_by("iteration", F.struct(F.col(series), F.col("iteration")))
        value = F.min(series)
    known = history.where(F.col(series).isNotNull())
    return known.groupBy(*groups).agg(chosen.alias("best_iteration"), value.alias("best_value"))


def score_at_iteration(model: GBTClassificationModel | GBTRegressionModel, df: DataFrame,
                       iteration: int) -> DataFrame:
    """Score with the first ``iteration`` trees only.

    A classifier adds ``prob`` and ``pred``, a regressor adds ``los_pred``.
    """
    staged = staged_outputs(model, df, "_staged", iteration)
    margin = F.element_at("_staged", -1)
    if isinstance(model, GBTClassificationModel):
        return staged.select(*df.columns, margin_probability(margin).alias("prob")).withColumn(
            "pred", (F.col("prob") > 0.5).cast("int")
        )
    return staged.select(*df.columns, margin.alias("los_pred"))


def score_first_trees(model: GBTClassificationModel | GBTRegressionModel, df: DataFrame, trees: int) -> DataFrame:
    """Score with the first ``trees``; in the JVM where these are all."""
    if trees < model.getNumTrees:
        return score_at_iteration(model, df, trees)
    return score_mortality(model, df) if isinstance(model, GBTClassificationModel) else score_stay(model, df)
