"""Exact classification and regression metrics, overall or per group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.lookups import OUTCOME_NAMES
from wardloom.operators import skew

COUNTS = ("tp", "fp", "fn", "tn")


def _ratio(top: Column, bottom: Column) -> Column:
    """Share, 0 when undefined."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def _cells(label: Column, pred: Column) -> dict[str, Column]:
    return {
        "tp": F.count_if((label == 1) & (pred == 1)),
        "fp": F.count_if((label == 0) & (pred == 1)),
        "fn": F.count_if((label == 1) & (pred == 0)),
        "tn": F.count_if((label == 0) & (pred == 0)),
    }


def precision() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fp"))


def recall() -> Column:
    return _ratio(F.col("tp"), F.col("tp") + F.col("fn"))


def f1_score() -> Column:
    return _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))


def confusion_counts(scored: DataFrame, groups: Sequence[str] = (), label: str = "label",
                     pred: str = "pred") -> DataFrame:
    """``tp fp fn tn`` per group, in one pass with map-side counting."""
    cells = _cells(F.col(label), F.col(pred))
    return scored.groupBy(*groups).agg(*[c.alias(name) for name, c in cells.items()])


def ranking_counts(scored: DataFrame, groups: Sequence[str] = (), label: str = "label",
                   score: str = "prob", pred: str | None = None,
                   min_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """Per group: AUC plus row, label and (with ``pred``) confusion counts.

    AUC is the share of (positive, negative) pairs in the right order, ties
    counted half; null when a group has one class only.

    Rows are first counted per distinct score, on the map side, so a tied
    score or a large group costs nothing extra. The distinct scores are then
    ranked inside score ranges of about ``min_rows`` rows of all groups together;
    ranges are put together from their totals, so no task sorts more than one.
    Only the rows are counted, and for more than one range cut, at once.
    """
    groups = list(groups)
    valid = scored.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    columns = [*groups, label, score] + ([pred] if pred else [])
    valid = valid.select(*dict.fromkeys(columns))
    cuts = skew.range_cuts(valid.select(F.col(score).cast("double").alias("_s")), "_s", min_rows)

    cells = _cells(F.col(label), F.col(pred)) if pred else {}
    per_score = valid.groupBy(*groups, F.col(score).cast("double").alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"),
        F.count_if(F.col(label) == 0).alias("_neg"),
        *[c.alias(name) for name, c in cells.items()],
    )
    ranged = skew.with_range(per_score, "_score", cuts, "_range")
    lower = (
        Window.partitionBy(*groups, "_range").orderBy("_score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_range = (
        ranged.withColumn("_below", F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
        .groupBy(*groups, "_range")
        .agg(
            F.sum("_pos").alias("_pos"),
            F.sum("_neg").alias("_neg"),
            F.sum(F.col("_pos").cast("double") * (F.col("_below") + F.col("_neg") / F.lit(2.0)))
            .alias("_ordered"),
            *[F.sum(name).alias(name) for name in cells],
        )
    )
    # one row for each group and range from here on
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.sum("_pos").cast("double") * F.sum("_neg").cast("double")
    ordered = F.sum(F.col("_ordered") + F.col("_pos").cast("double") * F.col("_before"))
    return (
        per_range.withColumn("_before", F.coalesce(F.sum("_neg").over(earlier), F.lit(0)))
        .groupBy(*groups)
        .agg(
            F.try_divide(ordered, pairs).alias("auc_roc"),
            (F.sum("_pos") + F.sum("_neg")).alias("n_samples"),
            F.sum("_pos").alias("n_positive"),
            *[F.sum(name).alias(name) for name in cells],
        )
    )


# Validation rows to each range of scores that one task puts in order.
RANGE_ROWS = 200_000
# Values that a task packs at once, and rows that the range cuts are taken from.
PACKED_VALUES = 1_000_000
CUT_SAMPLE = 2_000


def staged_auc(staged: DataFrame, label: str, iterations: int, name: str = "staged", range_rows: int = RANGE_ROWS) -> DataFrame:
    """``iteration, auc_roc`` of the scores in an array column, one entry for each iteration.

    Each task turns its rows into sorted counts per score before anything leaves
    it: one record per iteration and score range, with the distinct scores and
    how many positives and negatives have each. Such records are merged by
    iteration and range, and the ranges put together from their totals. The
    ranges follow the number of rows, so no task holds more than about
    ``range_rows`` scores; their cuts come from a bounded sample and decide
    nothing but where a score is counted.
    """
    valid = staged.where(F.col(label).isin(0, 1) & F.col(name).isNotNull()).select(F.col(label).cast("int").alias("y"), F.col(name).alias("s"))
    ranges = -(-valid.count() // range_rows)
    cuts = np.zeros((iterations, 0))
    if ranges > 1:
        some = [r["s"] for r in valid.orderBy(F.xxhash64("s")).limit(CUT_SAMPLE).select("s").collect()]
        cuts = np.quantile(np.array(some), np.arange(1, ranges) / ranges, axis=0).T
    sent = staged.sparkSession.sparkContext.broadcast(cuts)
    at_once = max(1, PACKED_VALUES // max(1, iterations))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            y = np.concatenate([h[0] for h in held])
            scores = np.concatenate([h[1] for h in held])
            rows = []
            for i in range(iterations):
                values, place = np.unique(scores[:, i], return_inverse=True)
                n = np.bincount(place, minlength=len(values))
                positive = np.bincount(place, weights=y, minlength=len(values)).astype(np.int64)
                edges = [0, *np.searchsorted(values, sent.value[i], side="right").tolist(), len(values)]
                for r, (a, b) in enumerate(zip(edges, edges[1:])):
                    if b > a:
                        rows.append((i + 1, r, values[a:b], positive[a:b], (n - positive)[a:b]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], f.type) for k, f in enumerate(_PACKED)], schema=_PACKED)

        for batch in batches:
            y = batch.column(0).to_numpy(zero_copy_only=False)
            scores = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, iterations)
            for a in range(0, len(y), at_once):
                held.append((y[a : a + at_once], scores[a : a + at_once]))
                size += len(held[-1][0])
                if size >= at_once:
                    yield counted()
                    held, size = [], 0
        if held:
            yield counted()

    def merge(table: pa.Table) -> pa.Table:
        scores, positive, negative = (table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("scores", "pos", "neg"))
        order = np.argsort(scores, kind="stable")
        scores, positive, negative = scores[order], positive[order], negative[order]
        first = np.flatnonzero(np.append(True, scores[1:] != scores[:-1]))
        positive, negative = np.add.reduceat(positive, first), np.add.reduceat(negative, first)
        below = np.cumsum(negative) - negative
        ordered = float((positive.astype(np.float64) * (below + negative / 2)).sum())
        row = [table["iteration"][0].as_py(), table["range"][0].as_py(), int(positive.sum()), int(negative.sum()), ordered]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, _MERGED)], schema=_MERGED)

    packed = valid.mapInArrow(pack, "iteration int, range int, scores array<double>, pos array<long>, neg array<long>")
    merged = packed.groupBy("iteration", "range").applyInArrow(merge, "iteration int, range int, pos long, neg long, ordered double")
    earlier = Window.partitionBy("iteration").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    pairs = F.sum("pos").cast("double") * F.sum("neg").cast("double")
    return (
        merged.withColumn("before", F.coalesce(F.sum("neg").over(earlier), F.lit(0)))
        .groupBy("iteration")
        .agg(F.try_divide(F.sum(F.col("ordered") + F.col("pos").cast("double") * F.col("before")), pairs).alias("auc_roc"))
    )


_PACKED = pa.schema([
    ("iteration", pa.int32()), ("range", pa.int32()), ("scores", pa.list_(pa.float64())),
    ("pos", pa.list_(pa.int64())), ("neg", pa.list_(pa.int64())),
])
_MERGED = pa.schema([("iteration", pa.int32()), ("range", pa.int32()), ("pos", pa.int64()), ("neg", pa.int64()), ("ordered", pa.float64())])


def roc_auc(scored: DataFrame, groups: Sequence[str] = (), label: str = "label",
            score: str = "prob", min_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    return ranking_counts(scored, groups, label, score, min_rows=min_rows).select(*groups, "auc_roc")


def binary_metrics(scored: DataFrame, groups: Sequence[str] = (), label: str = "label",
                   score: str = "prob", pred: str = "pred") -> DataFrame:
    """AUC, precision, recall and F1, overall or per group."""
    return ranking_counts(scored, groups, label, score, pred).select(
        *groups,
        "auc_roc",
        precision().alias("precision"),
        recall().alias("recall"),
        f1_score().alias("f1_score"),
    )


def confusion_matrix(scored: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """All four cells, empty ones as 0."""
    return confusion_counts(scored, label=label, pred=pred).select(
        F.expr("stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp)").alias("actual", "predicted", "n")
    )


def class_report(scored: DataFrame, label: str = "label", pred: str = "pred",
                 names: tuple[str, str] = OUTCOME_NAMES) -> DataFrame:
    """Per-class rows, then accuracy, macro and weighted averages.

    Built from the four cells, so the table is scanned once.
    """
    cells = confusion_counts(scored, label=label, pred=pred)
    n0, n1 = F.col("tn") + F.col("fp"), F.col("tp") + F.col("fn")
    total = n0 + n1
    parts = cells.select(
        n0.alias("n0"), n1.alias("n1"), total.alias("n"),
        _ratio(F.col("tn"), F.col("tn") + F.col("fn")).alias("p0"),
        _ratio(F.col("tn"), n0).alias("r0"),
        _ratio(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")).alias("f0"),
        precision().alias("p1"), recall().alias("r1"), f1_score().alias("f1"),
        _ratio(F.col("tp") + F.col("tn"), total).alias("acc"),
    )
    weight = "coalesce(try_divide(n0 * {0}0 + n1 * {0}1, n), 0D)"
    return parts.select(
        F.expr(
            "stack(5,"
            f" '{names[0]}', p0, r0, f0, n0,"
            f" '{names[1]}', p1, r1, f1, n1,"
            " 'accuracy', cast(null as double), cast(null as double), acc, n,"
            " 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n,"
            f" 'weighted avg', {weight.format('p')}, {weight.format('r')}, {weight.format('f')}, n)"
        ).alias("class", "precision", "recall", "f1_score", "support")
    )


def log_loss(scored: DataFrame, groups: Sequence[str] = (), label: str = "label",
             score: str = "prob", floor: float = 1e-15) -> DataFrame:
    """Mean cross-entropy over known rows; probabilities are clipped off 0 and 1."""
    chosen = F.when(F.col(label) == 1, F.col(score)).when(F.col(label) == 0, 1 - F.col(score))
    # least() and greatest() skip nulls, so a missing value is kept out by hand
    clipped = F.when(chosen.isNotNull(), F.least(F.greatest(chosen, F.lit(floor)), F.lit(1 - floor)))
    return scored.groupBy(*groups).agg(F.avg(-F.log(clipped)).alias("log_loss"))


def regression_metrics(scored: DataFrame, groups: Sequence[str] = (), actual: str = "los_days",
                       predicted: str = "los_pred") -> DataFrame:
    """MSE, RMSE, MAE and R2 over rows where both values are known.

    The total sum of squares comes from the population variance, which Spark
    merges stably across partitions. R2 is null when the actual values do not
    vary.
    """
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    error = p - y  # null, and so skipped, unless both are known
    return (
        scored.groupBy(*groups)
        .agg(
            F.avg(error * error).alias("mse"),
            F.avg(F.abs(error)).alias("mae"),
            F.var_pop(F.when(p.isNotNull(), y)).alias("_var"),
        )
        .select(
            *groups,
            "mse",
            F.sqrt("mse").alias("rmse"),
            "mae",
            (F.lit(1.0) - F.try_divide("mse", "_var")).alias("r2"),
        )
    )


def metric_table(scored: DataFrame) -> DataFrame:
    """The seven headline numbers as ``Metric, Value`` rows."""
    outcome = binary_metrics(scored).select(
        F.expr(
            "stack(4, 'AUC-ROC', auc_roc, 'Precision', precision, 'Recall', recall, 'F1-Score', f1_score)"
        ).alias("Metric", "Value")
    )
    stay = regression_metrics(scored).select(
        F.expr("stack(3, 'LOS RMSE', rmse, 'LOS MAE', mae, 'LOS R²', r2)").alias("Metric", "Value")
    )
    return outcome.unionAll(stay)
