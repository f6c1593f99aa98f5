"""Clinical tables derived from the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions.numeric import over_threshold
from wardloom.functions.times import elapsed_days
from wardloom.operators.skew import numbered
from wardloom.sources.clinical import ClinicalTables


def star(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def patients(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as patients."""
    return star(spark, folder, "customer").selectExpr(
        "c_custkey as subject_id",
        "case when c_custkey % 10 = 9 then null when c_custkey % 2 = 0 then 'F' else 'M' end as gender",
        "cast(18 + (c_custkey * 7) % 73 as int) as anchor_age",
    )


def admissions(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as admissions, with gaps in most columns; every 50th has an unknown patient."""
    return (
        star(spark, folder, "orders")
        .selectExpr(
            "o_orderkey as hadm_id",
            "case when o_orderkey % 50 = 49 then -o_custkey else o_custkey end as subject_id",
            "o_orderdate + ((o_orderkey * 7) % 24) * interval '1' hour as admittime",
            "case when o_orderkey % 97 <> 0 then o_orderdate"
            " + ((o_orderkey * 7) % 24 + (o_orderkey * 37) % 480) * interval '1' hour end as dischtime",
            "case when o_orderkey % 89 = 0 then null when o_orderpriority = '1-URGENT' then 1 else 0 end"
            " as hospital_expire_flag",
            "o_orderpriority as admission_type",
            "case when o_orderkey % 11 <> 0 then concat('WARD ', o_orderstatus) end as admission_location",
            "case o_orderkey % 3 when 0 then 'Medicare' when 1 then 'Medicaid' else 'Other' end as insurance",
            "case o_orderkey % 7 when 0 then null when 1 then 'SINGLE' when 2 then 'WIDOWED'"
            " else 'MARRIED' end as marital_status",
            "case o_orderkey % 12 when 0 then null when 1 then 'BLACK/AFRICAN AMERICAN'"
            " when 2 then 'BLACK/CAPE VERDEAN' when 3 then 'HISPANIC OR LATINO' when 4 then 'ASIAN - CHINESE'"
            " when 5 then 'UNKNOWN' when 6 then 'PATIENT DECLINED TO ANSWER' when 7 then 'WHITE - BRAZILIAN'"
            " when 8 then 'OTHER' when 9 then 'CAUCASIAN' else 'WHITE' end as race",
        )
    )


def diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as diagnoses, numbered per admission."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
             "l_tax", "l_shipdate"]
    lines = star(spark, folder, "lineitem").select("l_orderkey", *order)
    leading = F.col("l_linenumber") * F.lit(1e12) + F.col("l_partkey")
    return (
        numbered(lines, "l_orderkey", order, leading, "seq_num")
        .selectExpr(
            "l_orderkey as hadm_id",
            "cast(seq_num as int) as seq_num",
            "case when l_suppkey % 3 = 0 then 10 else 9 end as icd_version",
            "l_partkey as k",
        )
        .selectExpr(
            "hadm_id",
            "seq_num",
            "icd_version",
            "case when icd_version = 10 then (case k % 4 when 0 then 'I509' when 1 then 'N179'"
            " when 2 then 'I429' else 'Q999' end)"
            " when k % 3 = 0 then (case k % 5 when 0 then '4280' when 1 then '0389' when 2 then '486'"
            " when 3 then 'V850' else '99592' end)"
            " when k % 31 = 1 then '25' when k % 37 = 2 then 'E9300'"
            " else cast(2400 + (k * seq_num) % 4200 as string) end as icd_code",
        )
    )


def clinical_tables(spark: SparkSession, folder: str) -> ClinicalTables:
    return ClinicalTables(
        patients(spark, folder), admissions(spark, folder), diagnoses(spark, folder)
    )


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Admissions with a deterministic stand-in for model output."""
    label = F.coalesce("hospital_expire_flag", F.lit(0))
    prob = ((F.col("hadm_id") * 7919) % 900 + label * 100).cast("double") / F.lit(1000.0)
    stay = elapsed_days(F.col("admittime"), F.col("dischtime"))
    return (
        admissions(spark, folder)
        .select("hadm_id", "race", label.alias("label"), stay.alias("los_days"), prob.alias("prob"))
        .withColumn("pred", over_threshold(F.col("prob")))
        .withColumn("los_pred", F.col("los_days") * F.lit(0.5) + F.col("hadm_id") % 20)
    )
