"""Metrics per analysis group and the spread between groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.functions.groups import race_group
from wardloom.operators.metrics import f1_score, precision, ranking_counts, recall


def with_race_group(df: DataFrame, which: str | lookups.Profile = "full") -> DataFrame:
    return df.withColumn("race_group", race_group(F.col("race"), which))


def group_metrics(
    scored: DataFrame,
    which: str | lookups.Profile = "full",
    min_size: int | None = None,
    label: str = "label",
    score: str = "prob",
    pred: str = "pred",
) -> DataFrame:
    """Size, label rate, AUC, precision, recall and F1 of every known group.

    The table is scored once beforehand; here it is only grouped. Groups below
    the profile's minimum size are left out after aggregation.
    """
    rules = lookups.profile(which)
    least = rules.min_group_size if min_size is None else min_size
    grouped = with_race_group(scored, rules).where(F.col("race_group") != "Unknown")
    return (
        ranking_counts(grouped, ["race_group"], label, score, pred)
        .where(F.col("n_samples") >= least)
        .select(
            "race_group",
            "n_samples",
            (F.col("n_positive") / F.col("n_samples")).alias("mortality_rate"),
            "auc_roc",
            precision().alias("precision"),
            recall().alias("recall"),
            f1_score().alias("f1_score"),
        )
    )


def by_size(groups: DataFrame) -> DataFrame:
    """Largest group first."""
    return groups.orderBy(F.desc("n_samples"), "race_group")


def _first_rows(scored: DataFrame, row_order: str, which: str | lookups.Profile) -> DataFrame:
    return with_race_group(scored, which).groupBy("race_group").agg(F.min(row_order).alias("_first"))


def by_first_seen(groups: DataFrame, scored: DataFrame, row_order: str,
                  which: str | lookups.Profile = "full") -> DataFrame:
    """Groups in the order in which their first row appears."""
    return groups.join(_first_rows(scored, row_order, which), "race_group").orderBy("_first", "race_group").drop("_first")


def placed_by_size(groups: DataFrame) -> DataFrame:
    """Add the 1-based ``place`` of each group, largest first; there are as few rows as groups."""
    return groups.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_samples"), "race_group")))


def placed_by_first_seen(groups: DataFrame, scored: DataFrame, row_order: str,
                         which: str | lookups.Profile = "full") -> DataFrame:
    """Add the 1-based ``place`` of each group in the order of first rows; there are as few rows as groups."""
    seen = groups.join(_first_rows(scored, row_order, which), "race_group")
    return seen.withColumn("place", F.row_number().over(Window.orderBy("_first", "race_group"))).drop("_first")


def disparity(groups: DataFrame) -> DataFrame:
    """Spread and mean of the group AUCs; null when fewer than two have one."""
    several = F.count("auc_roc") > 1
    spread = F.when(several, F.max("auc_roc") - F.min("auc_roc"))
    return groups.agg(
        F.count(F.lit(1)).alias("n_groups"),
        spread.alias("auc_disparity"),
        F.avg("auc_roc").alias("mean_auc"),
    ).withColumn(
        "verdict",
        F.when(F.col("auc_disparity") > lookups.DISPARITY_LIMIT, "significant")
        .when(F.col("auc_disparity").isNotNull(), "minimal"),
    )
