"""Diagnosis rows: harmonise, describe, order, and gather per admission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.functions.codes import code_description, harmonized_code
from wardloom.functions.lookups import Profile
from wardloom.functions.text import CODES_SHOWN
from wardloom.operators import skew
from wardloom.sources.schemas import ROW_LABEL

# Codes held in one array cell; longer lists go on in further rows.
LIST_PART = 10_000


def harmonized(dx: DataFrame, which: str | Profile = "full") -> DataFrame:
    """Add ``icd_code_harmonized``."""
    return dx.withColumn("icd_code_harmonized", harmonized_code(F.col("icd_code"), F.col("icd_version"), which))


def described(dx: DataFrame, which: str | Profile = "full") -> DataFrame:
    """Add ``wording`` for the harmonised code."""
    return dx.withColumn("wording", code_description(F.col("icd_code_harmonized"), which))


def positioned(
    dx: DataFrame,
    order_by: str | None = None,
    min_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Add the 1-based ``position`` of each code within its admission.

    File order (the row label) is the default; a source without row labels
    falls back to ``seq_num``, with the code itself breaking ties. Rows
    without an admission are dropped, as they belong to none.
    """
    first = order_by or (ROW_LABEL if ROW_LABEL in dx.columns else "seq_num")
    ties = [c for c in (first, "seq_num", "icd_version", "icd_code") if c in dx.columns]
    order = [F.col(c).asc_nulls_last() for c in dict.fromkeys(ties)]
    leading = F.coalesce(F.col(first).cast("double"), F.lit(float("inf")))
    return skew.numbered(
        dx.where(F.col("hadm_id").isNotNull()), "hadm_id", order, leading, "position", min_rows
    )


def gathered(coded: DataFrame) -> DataFrame:
    """One row per admission: its first codes, their wordings, and the count of all.

    Input needs ``position``, ``icd_code_harmonized`` and ``wording``. Only the
    ``CODES_SHOWN`` codes that a paragraph can show are here; every code is in
    ``list_parts``.
    """
    shown = F.col("position") <= CODES_SHOWN
    codes = F.when(shown, F.struct("position", "icd_code_harmonized"))
    wordings = F.when(shown, F.struct("position", "wording"))
    return coded.groupBy("hadm_id").agg(
        F.sort_array(F.collect_list(codes))["icd_code_harmonized"].alias("first_codes"),
        F.sort_array(F.collect_list(wordings))["wording"].alias("diagnosis_wordings"),
        F.count("seq_num").alias("num_diagnoses"),
    )


def list_parts(coded: DataFrame, part_size: int = LIST_PART) -> DataFrame:
    """Every code of every admission, in as many arrays of ``part_size`` as it takes."""
    part = F.floor((F.col("position") - 1) / part_size).cast("int").alias("part")
    entry = F.struct("position", "icd_code_harmonized")
    return coded.groupBy("hadm_id", part).agg(
        F.sort_array(F.collect_list(entry))["icd_code_harmonized"].alias("diagnosis_codes"),
        F.count("seq_num").alias("num_diagnoses"),
    )


def diagnosis_lists(
    dx: DataFrame,
    which: str | Profile = "full",
    order_by: str | None = None,
    part_size: int = LIST_PART,
    min_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Raw diagnosis rows to the whole code list of each admission, in parts."""
    return list_parts(harmonized(positioned(dx, order_by, min_rows), which), part_size)


def diagnosis_summaries(
    dx: DataFrame,
    which: str | Profile = "full",
    order_by: str | None = None,
    min_rows: int = skew.HEAVY_ROWS,
) -> DataFrame:
    """Raw diagnosis rows to one row per admission."""
    placed = positioned(dx, order_by, min_rows)
    return gathered(described(harmonized(placed, which), which))
