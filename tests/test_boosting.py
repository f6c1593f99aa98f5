"""Trees from histograms of blocks: the library's trees, without the library's fit."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from wardloom.operators import boosting, models


def made(spark, n=400, width=9, seed=11):
    """Sparse rows with repeated values and signs, some empty, some dense; a label and a length that depend on them."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, width)) < 0.4, np.round(rng.normal(size=(n, width)), 2), 0.0)
    x[0] = 0.0
    x[:, -1] = x[:, 0]  # a column that equals another one
    y = (x[:, 1] + x[:, 2] + 0.5 * rng.normal(size=n) > 0).astype(int)
    stay = 3 * x[:, 3] - x[:, 4] + 0.1 * rng.normal(size=n)
    vector = lambda i, v: Vectors.dense(v) if i % 7 == 0 else Vectors.sparse(width, [(int(j), float(v[j])) for j in np.flatnonzero(v)])
    rows = [(i, int(y[i]), float(stay[i]), vector(i, x[i])) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "hospital_expire_flag", "los_days", "features"]).repartition(5).cache()


def scores(model, df, score, name):
    return [r[0] for r in score(model, df).orderBy("id").select(name).collect()]


@pytest.fixture
def no_library(monkeypatch):
    """The library's own fit, put out of reach of the operators."""
    fits = {kind: kind._fit for kind in (GBTClassifier, GBTRegressor)}

    def refused(self, dataset):
        raise AssertionError("this fit reads every feature of every row")

    for kind in fits:
        monkeypatch.setattr(kind, "_fit", refused)
    return fits


@pytest.mark.parametrize("block_rows, block_entries", [(1 << 16, 1 << 20), (37, 90)])
def test_the_librarys_trees(spark, no_library, monkeypatch, block_rows, block_entries):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", block_entries)
    df = made(spark)
    settings = dict(maxIter=12, maxDepth=4, stepSize=0.1, seed=42)
    found = models.fit_mortality(df, trees=12, depth=4)
    library = no_library[GBTClassifier](GBTClassifier(labelCol="hospital_expire_flag", **settings), df.withColumn("hospital_expire_flag", F.col("hospital_expire_flag").cast("double")))
    assert scores(found, df, models.score_mortality, "prob") == pytest.approx(scores(library, df, models.score_mortality, "prob"), abs=1e-9)
    assert found.treeWeights == library.treeWeights and found.numFeatures == library.numFeatures == 9
    # splits of small nodes into the same rows by different columns are ties
    assert found.featureImportances.toArray() == pytest.approx(library.featureImportances.toArray(), abs=0.05)
    assert [t.numNodes for t in found.trees][0] == [t.numNodes for t in library.trees][0]
    stay = models.fit_stay(df, trees=6, depth=3)
    own = no_library[GBTRegressor](GBTRegressor(labelCol="los_days", maxIter=6, maxDepth=3, stepSize=0.1, seed=42), df)
    assert scores(stay, df, models.score_stay, "los_pred") == pytest.approx(scores(own, df, models.score_stay, "los_pred"), abs=1e-9)


def test_the_library_stops_there_too(spark, no_library):
    df = made(spark)
    train, val = df.where("id % 4 > 0"), df.where("id % 4 = 0")
    found = models.fit_mortality(train, trees=30, depth=2, validation=val)
    marked = df.select(F.col("hospital_expire_flag").cast("double").alias("hospital_expire_flag"), "features", (F.col("id") % 4 == 0).alias("held"))
    library = no_library[GBTClassifier](GBTClassifier(labelCol="hospital_expire_flag", maxIter=30, maxDepth=2, stepSize=0.1, seed=42, validationIndicatorCol="held", validationTol=models.VALIDATION_TOLERANCE), marked)
    assert found.getNumTrees == library.getNumTrees < 30
    assert scores(found, df, models.score_mortality, "prob") == pytest.approx(scores(library, df, models.score_mortality, "prob"), abs=1e-9)


def test_blocks_are_bounded_and_hold_what_is_not_zero(spark, monkeypatch):
    """No block has more rows or, beyond one row, more entries than it may; every row is in one, and zeros in none."""
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 50)
    monkeypatch.setattr(boosting, "BLOCK_ENTRIES", 120)
    seen = []
    ask = boosting._ask
    monkeypatch.setattr(boosting, "_ask", lambda blocks, *a: (seen or seen.extend(blocks.collect())) and None or ask(blocks, *a))
    df = made(spark)
    models.fit_stay(df, trees=1, depth=1)
    blocks = [boosting.pickle.loads(b.block) for b in seen]
    assert max(len(b.label) for b in blocks) <= 50 and max(len(b.rows) for b in blocks) <= 120
    assert sorted(np.concatenate([b.label for b in blocks]).tolist()) == sorted(r.los_days for r in df.collect())
    entries = sum(int((r.features.toArray() != 0).sum()) for r in df.collect())
    assert 0 < sum(len(b.rows) for b in blocks) <= entries


def test_what_cannot_be_fitted(spark):
    df = made(spark, 30)
    for bad, message in (
        (df.limit(0), "no rows"), (df.withColumn("los_days", F.lit(float("nan"))), "no number"),
        (df.withColumn("features", F.when(F.col("id") > 3, F.col("features"))), "no vector"),
    ):
        with pytest.raises(Exception, match=message):
            models.fit_stay(bad, trees=1)
    with pytest.raises(Exception, match="not 0 or 1"):
        models.fit_mortality(df.withColumn("hospital_expire_flag", F.lit(2)), trees=1)
    constant = models.fit_stay(df.withColumn("los_days", F.lit(4.0)), trees=3)
    assert set(scores(constant, df, models.score_stay, "los_pred")) == {4.0}


def test_vectors_of_a_fit_stay_out_of_memory(spark, monkeypatch):
    """Rows of a written table are read again; others are kept on disk only, and blocks too."""
    df = made(spark, 60).select("id", "hospital_expire_flag", "features")
    levels, fit = [], boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda estimator, rows, held=None: levels.append(rows.storageLevel) or fit(estimator, rows, held))
    ask = boosting._ask
    monkeypatch.setattr(boosting, "_ask", lambda blocks, *a: levels.append(blocks.getStorageLevel()) or ask(blocks, *a))
    models.fit_mortality(df.where("id >= 0"), trees=1, depth=1, validation=df.where("id < 9"))
    models.fit_mortality(df.where("id >= 0"), trees=1, depth=1, written=True)
    assert len(levels) > 4 and not any(level.useMemory for level in levels)
    assert levels[0].useDisk and not any(level.useDisk for level in levels if level not in (levels[0], levels[1]))
