"""Heads fitted by distributed gradients, staged measures, early stop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardloom.operators import head_training as ht
from wardloom.operators import heads, metrics, models


def layers_of(sizes, seed=7):
    rng = np.random.default_rng(seed)
    return [(rng.normal(size=(a, b)) * 0.5, rng.normal(size=b) * 0.1) for a, b in zip(sizes, sizes[1:])]


def losses(kind, layers, x, y):
    z = x
    for i, (w, b) in enumerate(layers):
        z = z @ w + b
        if i + 1 < len(layers):
            z = np.maximum(z, 0)
    if kind == ht.SQUARES:
        return (z[:, 0] - y) ** 2
    z = z - z.max(axis=1, keepdims=True)
    return np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y.astype(int)]


@pytest.mark.parametrize("kind, sizes", [(ht.CLASSES, (3, 5, 4)), (ht.SQUARES, (3, 6, 4, 1))])
def test_slopes_are_the_losses(kind, sizes):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 3)), rng.integers(0, 4, 40).astype(float)
    layers = layers_of(sizes)
    total, slopes = ht.gradient(kind, layers, x, y)
    assert total == pytest.approx(losses(kind, layers, x, y).sum(), rel=1e-12)
    for k, (w, b) in enumerate(layers):
        for part, slope in ((w, slopes[k][0]), (b, slopes[k][1])):
            for place in np.ndindex(part.shape):
                kept = part[place]
                part[place] = kept + 1e-6
                up = losses(kind, layers, x, y).sum()
                part[place] = kept - 1e-6
                down = losses(kind, layers, x, y).sum()
                part[place] = kept
                assert slope[place] == pytest.approx((up - down) / 2e-6, abs=2e-4)


def table(spark, x, y):
    return spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, v array<double>, y double")


@pytest.mark.parametrize("kind, sizes", [(ht.CLASSES, (3, 8, 2)), (ht.SQUARES, (3, 8, 4, 1))])
def test_one_step_against_numpy(spark, kind, sizes):
    """The first step, worked out whole on one machine, to 1e-9."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x[:, 0] > 0).astype(float) if kind == ht.CLASSES else x[:, 0] * 3
    layers = layers_of(sizes)
    settings = ht.HeadSettings(epochs=4, rate=0.05)
    df = table(spark, x, y).repartition(7)
    found = ht.train_head(df.where("id < 200"), df.where("id >= 200"), "v", "y", layers, kind, settings)
    _, slopes = ht.gradient(kind, layers, x[:200], y[:200])
    g = ht._flat(slopes) / 200
    g *= min(1.0, 1.0 / (np.linalg.norm(g) + 1e-6))
    w = ht._flat(layers) * (1 - 0.05 * 0.01)
    w -= 0.05 * g / (np.sqrt(g * g) + 1e-8)
    assert ht._flat(found.stages[0]) == pytest.approx(w, abs=1e-9)
    assert found.history[0][1] == pytest.approx(losses(kind, layers, x[:200], y[:200]).mean(), rel=1e-9)
    for (_, _, val_loss, _), stage in zip(found.history, found.stages):
        assert val_loss == pytest.approx(losses(kind, stage, x[200:], y[200:]).mean(), rel=1e-9)
    assert found.history[-1][1] < found.history[0][1]
    measured = [row[3] for row in found.history] if kind == ht.CLASSES else [-row[2] for row in found.history]
    assert found.best == 1 + measured.index(max(measured))
    assert [r.kept for r in found.table(spark).orderBy("iteration").collect()].index(True) + 1 == found.best
    if kind == ht.CLASSES:
        scored = heads.classifier_scores(df.where("id >= 200"), "v", found.layers).withColumnRenamed("y", "label")
        assert metrics.roc_auc(scored).first().auc_roc == pytest.approx(found.history[found.best - 1][3])


def test_heads_without_rows(spark):
    none = spark.createDataFrame([(1, None, 1.0), (2, [1.0, 2.0], None)], "id long, v array<double>, y double")
    some = spark.createDataFrame([(1, [0.5, 1.0], 1.0), (2, [1.0, 2.0], 0.0)], "id long, v array<double>, y double")
    layers = layers_of((2, 3, 2))
    idle = ht.train_head(none, some, "v", "y", layers, ht.CLASSES, ht.HeadSettings(epochs=2))
    assert ht._flat(idle.layers) == pytest.approx(ht._flat(layers)) and idle.history[0][1] is None and idle.best == 1
    unmeasured = ht.train_head(some, none, "v", "y", layers, ht.CLASSES, ht.HeadSettings(epochs=3))
    assert unmeasured.best == 3 and [row[2:] for row in unmeasured.history] == [(None, None)] * 3
    one_class = ht.train_head(some, some.where("y = 1"), "v", "y", layers, ht.CLASSES, ht.HeadSettings(epochs=2))
    assert [row[3] for row in one_class.history] == [None, None] and one_class.best == 2


def brute_auc(label, score):
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return None
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


@pytest.mark.parametrize("range_rows", [10, 97, 1_000_000])
def test_staged_auc(spark, monkeypatch, range_rows):
    """More iterations than one aggregate could hold, ties, and ranges that follow the rows."""
    monkeypatch.setattr(metrics, "PACKED_VALUES", 10_000)
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 400)
    scores = np.round(rng.normal(size=(400, 230)) + label[:, None] * np.linspace(0, 2, 230), 1)
    scores[:, 5] = 0.25
    rows = [(int(y), s.tolist()) for y, s in zip(label, scores)] + [(None, [0.0] * 230), (1, None)]
    df = spark.createDataFrame(rows, "label int, staged array<double>").repartition(5)
    found = metrics.staged_auc(df, "label", 230, range_rows=range_rows)
    got = {r.iteration: r.auc_roc for r in found.collect()}
    assert got == pytest.approx({i + 1: brute_auc(label, scores[:, i]) for i in range(230)}, abs=1e-12)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert metrics.staged_auc(df.where("label = 1"), "label", 230).where("auc_roc is not null").count() == 0
    assert metrics.staged_auc(df.limit(0), "label", 230).count() == 0


def vectors(spark, n=400):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist(), float(rng.normal())) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, v array<double>, noise double")
    return df.select(
        "id", array_to_vector("v").alias("features"), (F.col("v")[0] + 0.8 * F.col("noise") > 0).cast("int").alias("hospital_expire_flag"),
        (F.col("v")[0] * 3 + F.col("noise")).alias("los_days"),
    ).cache()


def test_fitting_stops_early(spark):
    """Trees after the best are not fitted, and the model is the first trees of the one that goes on."""
    df = vectors(spark)
    train, val = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    whole = models.fit_mortality(train, trees=25, depth=3)
    short = models.fit_mortality(train, trees=25, depth=3, validation=val)
    k = short.getNumTrees
    assert 1 <= k < 25
    first = models.score_at_iteration(whole, val, k).select("id", F.round("prob", 9).alias("p"))
    assert models.score_mortality(short, val).select("id", F.round("prob", 9).alias("p")).exceptAll(first).count() == 0
    loss = [r.val_loss for r in models.mortality_history(whole, train, val).collect()]
    assert loss[k - 1] == min(loss[:k])
    stay = models.fit_stay(train, trees=25, depth=3, validation=val.union(val.limit(1).withColumn("los_days", F.lit(None).cast("double"))))
    assert 1 <= stay.getNumTrees < 25


def test_history_ends_with_the_models_own_metrics(spark):
    df = vectors(spark)
    train, val = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    model = models.fit_mortality(train, trees=6, depth=3)
    last = models.mortality_history(model, train, val).collect()[-1]
    scored = models.score_mortality(model, val).withColumnRenamed("hospital_expire_flag", "label")
    assert last.val_auc == pytest.approx(metrics.roc_auc(scored).first().auc_roc, abs=1e-12)
    assert last.val_loss == pytest.approx(metrics.log_loss(scored).first().log_loss, abs=1e-9)
    stay = models.fit_stay(train, trees=6, depth=3)
    row = models.stay_history(stay, train, val).collect()[-1]
    own = metrics.regression_metrics(models.score_stay(stay, val)).first()
    assert (row.val_loss, row.val_mae) == pytest.approx((own.mse, own.mae), abs=1e-9)


@pytest.mark.parametrize("counters, most, expect", [(8, 8, "all"), (8, 512, "more"), (4096, 4096, "first")])
@pytest.mark.parametrize("kind", ["zipf", "ties", "few"])
def test_proven_vocabulary_is_the_vocabulary(spark, monkeypatch, counters, most, expect, kind):
    """Frequent and rare terms, ties at the edge, fewer terms than wanted: the same rows as counting all."""
    from wardloom.operators import features

    rng = np.random.default_rng(7)
    if kind == "zipf":
        docs = [[f"t{min(int(z), 3000)}" for z in rng.zipf(1.4, 60)] for _ in range(200)]
    elif kind == "ties":
        docs = [[f"t{(i + j) % 200}" for j in range(50)] for i in range(200)]
    else:
        docs = [[f"t{i % 5}", None, f"t{i % 3}"] for i in range(40)] + [[]]
    df = spark.createDataFrame([(i, [t for t in d if t]) for i, d in enumerate(docs)], "id long, terms array<string>").repartition(5)
    exact, fell_back = features.vocabulary, []
    monkeypatch.setattr(features, "vocabulary", lambda *a: fell_back.append(1) or exact(*a))
    got = features.proven_vocabulary(df, max_terms=30, counters=counters, most=most, buckets=4).collect()
    assert got == exact(df, "terms", 30).collect()
    if kind == "ties" and expect == "all":
        assert fell_back
    if expect == "first":
        assert not fell_back


def test_written_rows_are_cut_by_their_number(spark, tmp_path):
    """A few splits of a small file with many rows become as many tasks as the rows need."""
    from wardloom.operators.skew import spread

    place = str(tmp_path / "rows")
    spark.range(20_000).coalesce(8).write.parquet(place)
    scan = spark.read.parquet(place)
    cut = spread(scan, 1_000)
    assert cut.rdd.getNumPartitions() == 20 and cut.count() == 20_000
    assert max(r.n for r in cut.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 1_100
    assert spread(scan, 5_000).rdd.getNumPartitions() == spread(scan).rdd.getNumPartitions()


@pytest.mark.parametrize("kind, sizes", [(ht.CLASSES, (3, 8, 2)), (ht.SQUARES, (3, 8, 4, 1))])
def test_rows_go_through_the_layers_in_runs(spark, monkeypatch, kind, sizes):
    """No matrix has more rows than a run; sums and measures stay."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(300, 3))
    df = table(spark, x, (x[:, 0] > 0).astype(float)).repartition(2)
    fit = lambda: ht.train_head(df.where("id < 200"), df.where("id >= 200"), "v", "y", layers_of(sizes), kind, ht.HeadSettings(epochs=3, rate=0.05))
    whole, forward = fit(), ht._forward

    def short(layers, rows):
        assert len(rows) <= 16
        return forward(layers, rows)

    monkeypatch.setattr(ht, "ROWS_AT_ONCE", 16)
    monkeypatch.setattr(ht, "_forward", short)
    cut = fit()
    assert ht._flat(cut.layers) == pytest.approx(ht._flat(whole.layers), abs=1e-9) and cut.best == whole.best
    for a, b in zip(cut.history, whole.history, strict=True):
        assert a == pytest.approx(b, abs=1e-9)
