"""Fit small feed-forward heads on a vector column by distributed gradients.

Every epoch is one pass over the rows: each task adds up the loss and its
gradient over its training rows, and the losses over its validation rows, an
Arrow batch at a time. The tasks' sums, a few arrays, are added up by a handful
of tasks and then on the driver, which alone holds the weights and makes the
step (decoupled weight decay, linear warm-up and decay of the rate, the
gradient clipped by its norm). The weights of each epoch are kept, and after
the last pass the one that does best on the validation rows is the result.

Defined cases: rows with a null vector or label are neither fitted on nor
measured; without training rows the weights stay; without validation rows the
validation values are null and the last epoch is the result; the earliest of
equally good epochs is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.operators.heads import Layer
from wardloom.operators.metrics import staged_auc

# Tasks that add up the partial sums of all others.
ADDERS = 16
# Rows that go through the layers at once: what a task holds beside its batch is a few matrices of as many rows.
ROWS_AT_ONCE = 1024
BETAS, TINY = (0.9, 0.999), 1e-8
CLASSES, SQUARES = "classes", "squares"


@dataclass(frozen=True)
class HeadSettings:
    epochs: int = lookups.HEAD_EPOCHS
    rate: float = lookups.HEAD_RATE
    decay: float = lookups.HEAD_DECAY
    warm_up: float = lookups.HEAD_WARM_UP
    clip: float = lookups.HEAD_CLIP
    seed: int = lookups.SEED

    def rate_at(self, step: int) -> float:
        """Rate of the 0-based step: up along the warm-up, then down to 0 after the last."""
        rising = int(self.warm_up * self.epochs)
        if step < rising:
            return self.rate * step / max(1, rising)
        return self.rate * max(0.0, (self.epochs - step) / max(1, self.epochs - rising))


@dataclass
class FittedHead:
    layers: list[Layer]  # of the best epoch
    stages: list[list[Layer]]  # of every epoch
    history: list[tuple]  # epoch, train_loss, val_loss, val_auc or val_mae
    best: int
    measure: str

    def table(self, spark: SparkSession) -> DataFrame:
        """``iteration, train_loss, val_loss``, the measure, and ``kept`` for the epoch whose weights are the result."""
        rows = [(*row, row[0] == self.best) for row in self.history]
        return spark.createDataFrame(rows, f"iteration int, train_loss double, val_loss double, {self.measure} double, kept boolean")


def random_layers(sizes: Sequence[int], seed: int = lookups.SEED) -> list[Layer]:
    """Uniform weights within one over the square root of the inputs."""
    rng = np.random.default_rng(seed)
    return [(rng.uniform(-1, 1, (a, b)) / np.sqrt(a), rng.uniform(-1, 1, b) / np.sqrt(a)) for a, b in zip(sizes, sizes[1:])]


def _forward(layers: list[Layer], x: np.ndarray) -> list[np.ndarray]:
    """Inputs of every layer, then the outputs."""
    seen = [x]
    for i, (weights, bias) in enumerate(layers):
        x = x @ weights + bias
        if i + 1 < len(layers):
            x = np.maximum(x, 0.0)
        seen.append(x)
    return seen


def loss_and_slope(kind: str, outputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loss of each row, and its slope in the outputs."""
    if kind == SQUARES:
        error = outputs[:, 0] - labels
        return error * error, 2 * error[:, None]
    shifted = outputs - outputs.max(axis=1, keepdims=True)
    powers = np.exp(shifted)
    total = powers.sum(axis=1)
    rows, own = np.arange(len(labels)), labels.astype(np.int64)
    slope = powers / total[:, None]
    slope[rows, own] -= 1.0
    return np.log(total) - shifted[rows, own], slope


def gradient(kind: str, layers: list[Layer], x: np.ndarray, labels: np.ndarray) -> tuple[float, list[Layer]]:
    """Loss and its gradient, added up over the rows."""
    seen = _forward(layers, x)
    loss, slope = loss_and_slope(kind, seen[-1], labels)
    out: list[Layer] = []
    for i in range(len(layers) - 1, -1, -1):
        out.append((seen[i].T @ slope, slope.sum(axis=0)))
        if i:
            slope = (slope @ layers[i][0].T) * (seen[i] > 0)
    return float(loss.sum()), out[::-1]


def _flat(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in layers for part in layer])


def _unflat(numbers: np.ndarray, like: list[Layer]) -> list[Layer]:
    out, at = [], 0
    for weights, bias in like:
        w, at = numbers[at : at + weights.size].reshape(weights.shape), at + weights.size
        b, at = numbers[at : at + bias.size], at + bias.size
        out.append((w, b))
    return out


def pieces_of_rows(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.column(0):
            own = row.values.to_numpy()
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])


def epoch_sums(rows: DataFrame, layers: list[Layer], kind: str) -> np.ndarray:
    """Gradient, then training rows and loss, validation rows, loss and absolute error, over all rows.

    ``rows`` has x (array of doubles), y and held (true for validation rows).
    """
    sent = rows.sparkSession.sparkContext.broadcast(layers)
    width, size = layers[0][0].shape[0], _flat(layers).size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 5)
        for batch in (p for b in batches for p in pieces_of_rows(b, ROWS_AT_ONCE)):
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            y, held = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            if not held.all():
                loss, slopes = gradient(kind, sent.value, x[~held], y[~held])
                sums[:size] += _flat(slopes)
                sums[size : size + 2] += (~held).sum(), loss
            if held.any():
                outputs = _forward(sent.value, x[held])[-1]
                loss, _ = loss_and_slope(kind, outputs, y[held])
                sums[size + 2 :] += held.sum(), loss.sum(), np.abs(outputs[:, 0] - y[held]).sum()
        yield pa.RecordBatch.from_arrays([pa.array([sums], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.select("x", "y", "held").mapInArrow(run, "sums array<double>")
    few = parts.repartition(ADDERS).mapInArrow(_added, "sums array<double>").collect()
    return np.sum([r["sums"] for r in few], axis=0) if few else np.zeros(size + 5)


def train_head(train: DataFrame, held: DataFrame, vector: str, label: str, layers: list[Layer], kind: str = CLASSES,
               settings: HeadSettings = HeadSettings()) -> FittedHead:
    """Fit a head from the given first weights; the epoch that does best on ``held`` is kept.

    ``CLASSES`` fits class numbers by cross-entropy (best: largest AUC of class
    1), ``SQUARES`` a number by its squared error (best: smallest loss).
    """
    known = F.col(vector).isNotNull() & F.col(label).isNotNull()
    part = lambda df, is_held: df.where(known).select(
        F.col(vector).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"), F.lit(is_held).alias("held")
    )
    rows = part(train, False).unionByName(part(held, True)).persist(StorageLevel.MEMORY_AND_DISK)
    measure = "val_auc" if kind == CLASSES else "val_mae"
    weights = _flat(layers).astype(np.float64)
    first = second = np.zeros(weights.size)
    stages: list[list[Layer]] = []
    train_loss: list[float | None] = []
    val: list[tuple] = []
    try:
        for step in range(settings.epochs + 1):
            sums = epoch_sums(rows, _unflat(weights, layers), kind)
            n, loss, n_held, held_loss, held_error = sums[weights.size :].tolist()
            if step:
                val.append((held_loss / n_held, held_error / n_held) if n_held else (None, None))
            if step == settings.epochs:
                break
            train_loss.append(loss / n if n else None)
            slope = sums[: weights.size] / n if n else np.zeros(weights.size)
            slope = slope * min(1.0, settings.clip / (np.linalg.norm(slope) + 1e-6))
            first = BETAS[0] * first + (1 - BETAS[0]) * slope
            second = BETAS[1] * second + (1 - BETAS[1]) * slope * slope
            rate = settings.rate_at(step)
            if n:
                weights = weights * (1 - rate * settings.decay)
                weights = weights - rate * (first / (1 - BETAS[0] ** (step + 1))) / (np.sqrt(second / (1 - BETAS[1] ** (step + 1))) + TINY)
            stages.append(_unflat(weights, layers))
        values = _held_auc(rows, stages) if kind == CLASSES else [v[1] for v in val]
    finally:
        rows.unpersist()
    history = [(i + 1, train_loss[i], val[i][0], values[i]) for i in range(settings.epochs)]
    ranked = [(-row[3] if kind == CLASSES else row[2], row[0]) for row in history if row[3] is not None]
    best = min(ranked)[1] if ranked else settings.epochs
    return FittedHead(stages[best - 1] if stages else layers, stages, history, best, measure)


def _held_auc(rows: DataFrame, stages: list[list[Layer]]) -> list[float | None]:
    """AUC of class 1 on the validation rows after every epoch, all of them in one pass."""
    if not stages:
        return []
    sent = rows.sparkSession.sparkContext.broadcast(stages)
    width = stages[0][0][0].shape[0]

    @F.arrow_udf("array<double>")
    def scores(batch: pa.Array) -> pa.Array:
        x = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        out = np.empty((len(batch), len(sent.value)))
        for a in range(0, len(x), ROWS_AT_ONCE):
            for i, layers in enumerate(sent.value):
                logits = _forward(layers, x[a : a + ROWS_AT_ONCE])[-1]
                powers = np.exp(logits - logits.max(axis=1, keepdims=True))
                out[a : a + ROWS_AT_ONCE, i] = powers[:, 1] / powers.sum(axis=1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(sent.value)), pa.array(out.ravel()))

    staged = rows.where("held").select(F.col("y").alias("label"), scores("x").alias("staged"))
    found = {r["iteration"]: r["auc_roc"] for r in staged_auc(staged, "label", len(stages)).collect()}
    return [found.get(i + 1) for i in range(len(stages))]
