"""One row per admission: joins, features, text, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.functions.numeric import percent
from wardloom.functions.text import clinical_text
from wardloom.functions.times import admission_features
from wardloom.operators.diagnoses import diagnosis_summaries
from wardloom.sources.clinical import ClinicalTables


def left_lookup(left: DataFrame, right: DataFrame, key: str, null_safe: bool = False) -> DataFrame:
    """Left join on one key; the strategy is left to the optimizer's sizes.

    ``null_safe`` lets a null key match a null key.
    """
    if not null_safe:
        return left.join(right, key, "left")
    named = right.withColumnRenamed(key, "_right_key")
    return left.join(named, F.col(key).eqNullSafe(F.col("_right_key")), "left").drop("_right_key")


def time_features(admissions: DataFrame, which: str | lookups.Profile = "full") -> DataFrame:
    rules = lookups.profile(which)
    return admissions.withColumns(
        admission_features(F.col("admittime"), F.col("dischtime"), month=not rules.race_by_substring)
    )


def merged(
    tables: ClinicalTables,
    which: str | lookups.Profile = "full",
    order_by: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Admissions with time features, patient columns and first diagnoses.

    Diagnoses are brought down to one row per admission before the join, so
    the join cannot multiply rows. Admissions without any get an empty list
    and a count of 0.
    """
    patients = tables.patients.drop(*[c for c in tables.patients.columns if c.startswith("_")])
    # about one row per admission, and already laid out by admission: worth
    # neither a broadcast nor a second shuffle
    lists = diagnosis_summaries(tables.diagnoses, which, order_by).hint("merge")
    joined = left_lookup(
        left_lookup(time_features(tables.admissions, which), lists, "hadm_id", null_safe),
        patients,
        "subject_id",
        null_safe,
    )
    nothing = F.array().cast("array<string>")
    return joined.withColumns({
        "num_diagnoses": F.coalesce("num_diagnoses", F.lit(0)),
        "first_codes": F.coalesce("first_codes", nothing),
        "diagnosis_wordings": F.coalesce("diagnosis_wordings", nothing),
    })


def with_text(df: DataFrame, which: str | lookups.Profile = "full") -> DataFrame:
    return df.withColumn("clinical_text", clinical_text(df.columns, which))


def cohort(df: DataFrame, which: str | lookups.Profile = "full") -> DataFrame:
    """Merged table to the modelling table of the profile.

    Rows without a required value are dropped before the text is rendered.
    Text and label are built non-null, so only the other required columns
    need the test.
    """
    rules = lookups.profile(which)
    never_null = {"clinical_text", "hospital_expire_flag"}
    required = [c for c in rules.required_columns if c not in never_null]
    kept = df.dropna(subset=required) if required else df
    return (
        with_text(kept, rules)
        .withColumn("hospital_expire_flag", F.coalesce("hospital_expire_flag", F.lit(0)).cast("int"))
        .select(*rules.cohort_columns)
    )


def build_cohort(tables: ClinicalTables, which: str | lookups.Profile = "full") -> DataFrame:
    return cohort(merged(tables, which), which)


def cohort_profile(df: DataFrame) -> DataFrame:
    """Row count, label rate in percent (nulls skipped) and mean stay."""
    return df.agg(
        F.count(F.lit(1)).alias("n_admissions"),
        percent(F.avg("hospital_expire_flag")).alias("mortality_percent"),
        F.avg("los_days").alias("mean_los_days"),
    )


def split_profile(df: DataFrame, label: str = "hospital_expire_flag") -> DataFrame:
    """Size and label rate in percent of every split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), percent(F.avg(label)).alias("label_percent")
    )


def first_example(df: DataFrame, order_by: str) -> DataFrame:
    """One row to look at."""
    return df.orderBy(order_by).limit(1)
