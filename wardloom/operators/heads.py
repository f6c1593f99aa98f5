"""Small feed-forward heads applied to a vector column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.numeric import argmax, class_probability

# One layer is (weights of shape inputs x outputs, bias of shape outputs).
Layer = tuple[np.ndarray, np.ndarray]


def head_outputs(vectors: DataFrame, column: str, layers: list[Layer], name: str = "logits") -> DataFrame:
    """Add the outputs of a stack of linear layers with ReLU in between.

    The weights are data: a fixed, small set of matrices sent once to each
    executor. Vectors are scored a whole Arrow batch at a time; a null vector
    gives a null output.
    """
    width = layers[0][0].shape[0]
    for (weights, bias), (following, _) in zip(layers, layers[1:]):
        if weights.shape[1] != following.shape[0] or bias.shape != (weights.shape[1],):
            raise ValueError("layer shapes do not fit together")
    sent = vectors.sparkSession.sparkContext.broadcast([(np.asarray(w), np.asarray(b)) for w, b in layers])

    @F.arrow_udf("array<double>")
    def score(batch: pa.Array) -> pa.Array:
        valid = np.asarray(batch.is_valid())
        x = np.asarray(batch.flatten(), dtype=np.float64).reshape(-1, width)
        stack = sent.value
        for i, (weights, bias) in enumerate(stack):
            x = x @ weights + bias
            if i + 1 < len(stack):
                x = np.maximum(x, 0.0)
        # a null row spans no values; its null start offset keeps it null
        ends = np.concatenate([[0], np.cumsum(valid)]).astype(np.int32) * x.shape[1]
        offsets = pa.array(ends, pa.int32(), mask=np.append(~valid, False))
        return pa.ListArray.from_arrays(offsets, pa.array(x.ravel(), pa.float64()))

    return vectors.withColumn(name, score(F.col(column)))


def classifier_scores(vectors: DataFrame, column: str, layers: list[Layer]) -> DataFrame:
    """Add ``prob`` of class 1 and the predicted class (``pred``)."""
    scored = head_outputs(vectors, column, layers, "_logits")
    return scored.withColumns({
        "prob": class_probability(F.col("_logits")),
        "pred": argmax(F.col("_logits")),
    }).drop("_logits")


def regressor_scores(vectors: DataFrame, column: str, layers: list[Layer], name: str = "los_pred") -> DataFrame:
    """Add the single output of a regression head."""
    return head_outputs(vectors, column, layers, "_out").withColumn(name, F.get("_out", F.lit(0))).drop("_out")
