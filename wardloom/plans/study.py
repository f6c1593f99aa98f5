"""The whole study: cohort, split, features, models, scores, tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.operators import cohort as co
from wardloom.operators import fairness, metrics, models
from wardloom.operators.features import TfidfModel, fit_tfidf
from wardloom.operators.skew import TASK_ROWS, spread
from wardloom.operators.split import stratified_split
from wardloom.plans import reports
from wardloom.sources.clinical import ClinicalTables
from wardloom.sources.schemas import ROW_LABEL
from wardloom.sources.sinks import materialized, write_table


@dataclass(frozen=True)
class StudySettings:
    trees: int = lookups.BOOSTING_TREES
    depth: int = lookups.BOOSTING_DEPTH
    rate: float = lookups.BOOSTING_RATE
    max_terms: int = lookups.MAX_TERMS
    seed: int = lookups.SEED
    min_group_size: int | None = None


@dataclass
class StudyResult:
    cohort: DataFrame
    splits: DataFrame
    features: TfidfModel
    mortality_model: GBTClassificationModel
    los_model: GBTRegressionModel
    scored: DataFrame
    metric_table: DataFrame
    class_report: DataFrame
    fairness: DataFrame
    disparity: DataFrame
    summary: DataFrame
    profile: str
    mortality_trees: int  # that the scores come from: all, or up to the best iteration
    los_trees: int
    charts: dict[str, DataFrame] = field(default_factory=dict)
    history: dict[str, DataFrame] = field(default_factory=dict)


def run_study(tables: ClinicalTables, which: str | lookups.Profile = "compact",
              settings: StudySettings = StudySettings()) -> StudyResult:
    """Run one profile end to end.

    Three tables are written to the shared folder on the way: the cohort, its
    vectors, and the scored test split. Everything before a written table is
    computed once, and lost executors only cost work since the last one. All
    result tables are lazy aggregates of the scored split.

    The compact profile scores with all trees and lists groups by size; the
    full profile keeps the history of every iteration, scores with the best one
    on the validation split, and lists groups in the order of their first rows
    (by row label where the admissions have one, else by admission).
    """
    rules = lookups.profile(which)
    cohort = materialized(co.build_cohort(tables, rules), "cohort")
    rows = stratified_split(spread(cohort, TASK_ROWS), seed=settings.seed)
    tfidf = fit_tfidf(rows.where("split = 'train'"), "clinical_text", settings.max_terms)
    vectors = materialized(
        tfidf.transform(rows, "clinical_text")
        .select("hadm_id", "split", "race", "hospital_expire_flag", "los_days", "features"),
        "vectors",
    )
    train, val, test = (vectors.where(F.col("split") == name) for name in ("train", "val", "test"))

    boosting = dict(trees=settings.trees, depth=settings.depth, rate=settings.rate, seed=settings.seed)
    outcome = models.fit_mortality(train, written=True, **boosting)
    stay = models.fit_stay(train, written=True, **boosting)
    history: dict[str, DataFrame] = {}
    best_outcome, best_stay = outcome.getNumTrees, stay.getNumTrees
    if rules.race_by_substring:
        scored = models.score_stay(stay, models.score_mortality(outcome, test))
    else:
        history["mortality"] = materialized(models.mortality_history(outcome, train, val), "history")
        known = val.where("los_days is not null")
        history["los"] = materialized(
            models.stay_history(stay, train.where("los_days is not null"), known), "history"
        )
        best_outcome = _best(history["mortality"], "val_auc", True, settings.trees)
        best_stay = _best(history["los"], "val_loss", False, settings.trees)
        scored = models.score_at_iteration(
            stay, models.score_at_iteration(outcome, test, best_outcome), best_stay
        )
    scored = materialized(
        scored.select("hadm_id", "race", F.col("hospital_expire_flag").alias("label"), "prob", "pred",
                      "los_days", "los_pred"),
        "scored",
    )

    groups = fairness.group_metrics(scored, rules, settings.min_group_size)
    if rules.race_by_substring:
        placed = fairness.placed_by_size(groups)
    else:
        labelled = ROW_LABEL in tables.admissions.columns
        rows_of_groups = scored.join(tables.admissions.select("hadm_id", ROW_LABEL), "hadm_id") if labelled else scored
        placed = fairness.placed_by_first_seen(groups, rows_of_groups, ROW_LABEL if labelled else "hadm_id", rules)
    spread_of_groups = fairness.disparity(groups)
    charts = {
        "confusion": reports.confusion_chart(scored),
        "groups": reports.group_chart(groups),
        "residuals": reports.residual_histogram(scored),
        "density": reports.pred_actual_density(scored),
    } | {f"history_{name}": reports.history_long(df) for name, df in history.items()}
    return StudyResult(
        cohort=cohort,
        splits=co.split_profile(rows),
        features=tfidf,
        mortality_model=outcome,
        los_model=stay,
        scored=scored,
        metric_table=metrics.metric_table(scored),
        class_report=metrics.class_report(scored),
        fairness=placed,
        disparity=spread_of_groups,
        summary=reports.run_summary(scored, spread_of_groups),
        profile=rules.name,
        mortality_trees=best_outcome,
        los_trees=best_stay,
        charts=charts,
        history=history,
    )


def _best(history: DataFrame, series: str, largest: bool, otherwise: int) -> int:
    """Best iteration of a one-row-per-iteration history; the last if none has a value."""
    row = models.best_iteration(history, series, largest).first()
    return row["best_iteration"] if row and row["best_iteration"] else otherwise


def write_study(result: StudyResult, folder: str) -> list[str]:
    """Metric and group tables as CSV with a header."""
    return [
        write_table(result.metric_table, f"{folder}/model_results", single_file=True),
        write_table(result.fairness.orderBy("place").drop("place"), f"{folder}/fairness_analysis", single_file=True),
    ]
