import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from wardloom.operators import fairness, metrics, models, split
from wardloom.plans import reports

SCHEMA = "id long, race string, label int, prob double, pred int, los_days double, los_pred double"


def make_scored(rows, n=400, seed=1, ties=20):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        label = int(rng.random() < 0.3)
        prob = round(min(1, max(0, 0.3 * label + rng.random() * 0.7)) * ties) / ties
        race = rng.choice(["WHITE", "ASIAN", "UNKNOWN", "BLACK/AFRICAN AMERICAN", None, "HISPANIC OR LATINO"])
        stay = rng.random() * 20
        data.append((i, race, label, prob, int(prob > 0.5), stay, stay + rng.gauss(0, 2)))
    return data, rows(data, SCHEMA)


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("ties", [3, 20, 1_000_000])
@pytest.mark.parametrize("min_rows", [1, 1_000_000])
def test_auc(rows, ties, min_rows):
    data, df = make_scored(rows, ties=ties)
    got = metrics.roc_auc(df, min_rows=min_rows).first().auc_roc
    assert got == pytest.approx(brute_auc([(r[2], r[3]) for r in data]), abs=1e-12)
    flipped = df.withColumn("prob", 1 - F.col("prob"))
    assert metrics.roc_auc(flipped, min_rows=min_rows).first().auc_roc == pytest.approx(1 - got, abs=1e-12)


def test_auc_groups_with_one_hot_group(rows):
    data, df = make_scored(rows, n=600)
    grouped = df.withColumn("g", F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 7 + 1))
    got = {r.g: r.auc_roc for r in metrics.roc_auc(grouped, ["g"], min_rows=1).collect()}
    for g in got:
        rows_of_g = [(r[2], r[3]) for r in data if (0 if r[0] % 3 == 0 else r[0] % 7 + 1) == g]
        assert got[g] == pytest.approx(brute_auc(rows_of_g), abs=1e-12)


def test_auc_edges(rows):
    same = rows([(0, 0.5), (1, 0.5), (0, 0.5)], "label int, prob double")
    one = rows([(0, 0.2), (0, 0.5)], "label int, prob double")
    assert metrics.roc_auc(same).first().auc_roc == 0.5
    assert metrics.roc_auc(one).first().auc_roc is None


def test_threshold_and_undefined_precision(rows):
    df = rows([(1, 0.5), (0, 0.5)], "label int, prob double").withColumn("pred", (F.col("prob") > 0.5).cast("int"))
    got = metrics.binary_metrics(df).first()
    assert (got.precision, got.recall, got.f1_score) == (0.0, 0.0, 0.0)
    assert [r.n for r in metrics.confusion_matrix(df).orderBy("actual", "predicted").collect()] == [1, 0, 1, 0]


def test_report_adds_up(rows):
    data, df = make_scored(rows)
    assert metrics.confusion_matrix(df).agg(F.sum("n")).first()[0] == len(data)
    report = {r["class"]: r for r in metrics.class_report(df).collect()}
    hits = sum(r[2] == r[4] for r in data)
    assert report["accuracy"].f1_score == pytest.approx(hits / len(data))
    assert report["accuracy"].precision is None
    expired = [r for r in data if r[2] == 1]
    assert report["Expired"].recall == pytest.approx(sum(r[4] for r in expired) / len(expired))
    assert report["Expired"].support == len(expired)
    macro = (report["Expired"].f1_score + report["Survived"].f1_score) / 2
    assert report["macro avg"].f1_score == pytest.approx(macro)


def test_regression_metrics(rows):
    data, df = make_scored(rows)
    extra = df.unionAll(rows([(999, None, 0, 0.1, 0, None, 3.0), (998, None, 0, 0.1, 0, 5.0, None)], SCHEMA))
    got = metrics.regression_metrics(extra).first()
    errors = [r[6] - r[5] for r in data]
    mean = sum(r[5] for r in data) / len(data)
    mse = sum(e * e for e in errors) / len(errors)
    sst = sum((r[5] - mean) ** 2 for r in data) / len(data)
    assert got.mse == pytest.approx(mse) and got.rmse == pytest.approx(math.sqrt(mse))
    assert got.mae == pytest.approx(sum(map(abs, errors)) / len(errors))
    assert got.r2 == pytest.approx(1 - mse / sst)


def test_log_loss_is_clipped(rows):
    df = rows([(1, 0.0), (0, 0.25), (None, 0.5), (1, None)], "label int, prob double")
    expected = (-math.log(1e-15) - math.log(0.75)) / 2
    assert metrics.log_loss(df).first().log_loss == pytest.approx(expected)


def test_groups(rows):
    data, df = make_scored(rows)
    got = fairness.group_metrics(df, "full", min_size=1)
    names = {r.race_group for r in got.collect()}
    assert names == {"White", "Asian", "Black", "Other", "Hispanic"}
    assert fairness.group_metrics(df, "full", min_size=10_000).count() == 0
    sizes = [r.n_samples for r in fairness.by_size(got).collect()]
    assert sizes == sorted(sizes, reverse=True)
    seen = [r.race_group for r in fairness.by_first_seen(got, df, "id").collect()]
    firsts = {r.race_group: r.first for r in
              fairness.with_race_group(df).groupBy("race_group").agg(F.min("id").alias("first")).collect()}
    assert seen == sorted(seen, key=firsts.get)
    spread = fairness.disparity(got).first()
    aucs = [r.auc_roc for r in got.collect()]
    assert spread.auc_disparity == pytest.approx(max(aucs) - min(aucs))
    assert spread.mean_auc == pytest.approx(sum(aucs) / len(aucs))
    assert spread.verdict == ("significant" if spread.auc_disparity > 0.1 else "minimal")


def test_one_group_has_no_disparity(rows):
    df = rows([("White", 0.7, 3), ("Asian", None, 2)], "race_group string, auc_roc double, n_samples long")
    got = fairness.disparity(df).first()
    assert got.auc_disparity is None and got.verdict is None and got.n_groups == 2


# --- split --------------------------------------------------------------------


def brute_split(pairs, seed=42):
    out = {}
    for label in {y for _, y in pairs}:
        keys = sorted((hashlib.md5(f"{seed}:{k}".encode()).hexdigest(), k) for k, y in pairs if y == label)
        n = len(keys)
        held = -(-3 * n // 10)
        test = -(-held // 2)
        for i, (_, k) in enumerate(keys):
            out[k] = "test" if i < test else "val" if i < held else "train"
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 1000])
def test_split(rows, n):
    pairs = [(i, None if i % 50 == 3 else int(i % 3 == 0)) for i in range(n)]
    df = rows(pairs, "hadm_id long, hospital_expire_flag int")
    got = {r.hadm_id: r.split for r in split.stratified_split(df).collect()}
    assert got == brute_split(pairs)


def test_split_of_very_many_strata_uses_a_plain_join(rows, monkeypatch):
    monkeypatch.setattr(split, "BROADCAST_STRATA", 1)
    pairs = [(i, i % 4) for i in range(200)]
    df = rows(pairs, "hadm_id long, hospital_expire_flag int")
    assert {r.hadm_id: r.split for r in split.stratified_split(df).collect()} == brute_split(pairs)


def test_split_other_seed_and_shares(rows):
    df = rows([(i, 0) for i in range(100)], "hadm_id long, hospital_expire_flag int")
    a = split.stratified_split(df, seed=1, held_out=0.2, test_share=0.25)
    sizes = {r.split: r["count"] for r in a.groupBy("split").count().collect()}
    assert sizes == {"train": 80, "val": 15, "test": 5}
    assert a.exceptAll(split.stratified_split(df, seed=2, held_out=0.2, test_share=0.25)).count() > 0


def test_grouped_split_keeps_patients_together(rows):
    df = rows([(i, i % 20, int(i % 20 == 1)) for i in range(200)], "hadm_id long, subject_id long, y int")
    hot = df.withColumn("subject_id", F.when(F.col("hadm_id") % 3 == 0, F.lit(3)).otherwise(F.col("subject_id")))
    plain = split.grouped_split(hot, "y", "hadm_id", "subject_id")
    cut_up = split.grouped_split(hot, "y", "hadm_id", "subject_id", min_rows=50)
    assert plain.exceptAll(cut_up).count() == 0 and cut_up.count() == 200
    no_group = df.withColumn("subject_id", F.lit(None).cast("long"))
    assert split.grouped_split(no_group, "y", "hadm_id", "subject_id").where("split <> 'train'").count() == 0
    got = split.grouped_split(df, "y", "hadm_id", "subject_id")
    assert got.count() == 200
    assert got.groupBy("subject_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0


# --- reports ------------------------------------------------------------------


def test_histogram(rows):
    data, df = make_scored(rows)
    got = reports.residual_histogram(df).orderBy("bin").collect()
    errors = [r[6] - r[5] for r in data]
    low, width = min(errors), (max(errors) - min(errors)) / 50
    counts = [0] * 50
    for e in errors:
        counts[min(int((e - low) // width), 49)] += 1
    assert len(got) == 50 and sum(r.n for r in got) == len(data)
    missing = rows([(1, None, 0, 0.5, 0, None, 1.0)], SCHEMA)
    assert reports.residual_histogram(df.unionAll(missing)).orderBy("bin").collect() == got
    assert sum(abs(r.n - c) for r, c in zip(got, counts)) <= 2  # edges may differ in the last bit
    flat = rows([(1.0, 2.0), (3.0, 4.0), (None, 1.0)], "los_days double, los_pred double")
    bins = reports.residual_histogram(flat).collect()
    assert sum(r.n for r in bins) == 2 and min(r.low for r in bins) == 0.5


def test_density_covers_all_rows(rows):
    data, df = make_scored(rows)
    cells = reports.pred_actual_density(df)
    assert cells.agg(F.sum("n")).first()[0] == len(data)
    assert cells.agg(F.max("actual_bin")).first()[0] <= 49


def test_best_iteration_first_wins(rows):
    history = rows([(1, 0.5, 3.0), (2, 0.8, 2.0), (3, 0.8, 2.0), (4, None, None)],
                   "iteration int, val_auc double, val_loss double")
    assert models.best_iteration(history, "val_auc", True).first().best_iteration == 2
    assert models.best_iteration(history, "val_loss", False).first().best_iteration == 2
    assert reports.history_long(history).count() == 8
