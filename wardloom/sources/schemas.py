"""Declared schemas of the three input tables."""

from __future__ import annotations

from pyspark.sql import types as T

# File stems of the three tables and the name of the row-label column, which
# is the first, unnamed column of every CSV.
TABLE_FILES = {
    "patients": "patients_table",
    "admissions": "patient_admissions",
    "diagnoses": "disease_diagnosis_code",
}
ROW_LABEL = "_row_id"

PATIENTS = T.StructType([
    T.StructField("subject_id", T.LongType()),
    T.StructField("gender", T.StringType()),
    T.StructField("anchor_age", T.IntegerType()),
])

ADMISSIONS = T.StructType([
    T.StructField("hadm_id", T.LongType()),
    T.StructField("subject_id", T.LongType()),
    T.StructField("admittime", T.TimestampNTZType()),
    T.StructField("dischtime", T.TimestampNTZType()),
    T.StructField("deathtime", T.TimestampNTZType()),
    T.StructField("admission_type", T.StringType()),
    T.StructField("admission_location", T.StringType()),
    T.StructField("insurance", T.StringType()),
    T.StructField("marital_status", T.StringType()),
    T.StructField("race", T.StringType()),
    T.StructField("hospital_expire_flag", T.IntegerType()),
])

# icd_code stays text: leading zeros carry meaning.
DIAGNOSES = T.StructType([
    T.StructField("hadm_id", T.LongType()),
    T.StructField("seq_num", T.IntegerType()),
    T.StructField("icd_code", T.StringType()),
    T.StructField("icd_version", T.IntegerType()),
])

SCHEMAS = {"patients": PATIENTS, "admissions": ADMISSIONS, "diagnoses": DIAGNOSES}
