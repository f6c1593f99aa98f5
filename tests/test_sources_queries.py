from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as spec
from tools.check_queries import normalized
from wardloom.plans.study import StudySettings, run_study, write_study
from wardloom.sources import sinks
from wardloom.sources.clinical import load_tables, read_csv_table, table_sizes
from wardloom.sources.schemas import SCHEMAS
from wardloom.sources.star_tables import clinical_tables


@pytest.fixture
def csv_folder(tmp_path):
    (tmp_path / "patients_table.csv").write_text(
        ",subject_id,gender,anchor_age,anchor_year\n0,1,F,65.0,2180\n1,2,NA,,2181\n2,3,M,40,2182\n"
    )
    (tmp_path / "patient_admissions.csv").write_text(
        ",hadm_id,subject_id,admittime,dischtime,deathtime,admission_type,admission_location,insurance,"
        "marital_status,race,hospital_expire_flag,extra\n"
        '0,10,1,2180-05-06 22:23:00,2180-05-07 17:15:00,,URGENT,"TRANSFER, ""OTHER""",Other,None,WHITE,0.0,x\n'
        "1,11,2,2180-05-06 22:23:00,,NaN,URGENT,null, NA ,,nan,,y\n"
    )
    (tmp_path / "disease_diagnosis_code.csv").write_text(
        ",subject_id,hadm_id,seq_num,icd_code,icd_version\n5,1,10,2,0389,9\n4,1,10,1,00845,9\n"
    )
    return str(tmp_path)


def test_csv(spark, csv_folder):
    tables = load_tables(spark, csv_folder)
    patients = tables.patients.orderBy("subject_id").collect()
    assert [(r._row_id, r.gender, r.anchor_age) for r in patients] == [(0, "F", 65), (1, None, None), (2, "M", 40)]
    first, second = tables.admissions.orderBy("hadm_id").collect()
    assert first.admission_location == 'TRANSFER, "OTHER"' and first.marital_status is None
    assert first.hospital_expire_flag == 0 and str(first.admittime) == "2180-05-06 22:23:00"
    assert second.admission_location is None and second.insurance == " NA " and second.race is None
    assert second.dischtime is None and second.hospital_expire_flag is None
    assert "extra" not in tables.admissions.columns
    codes = tables.diagnoses.orderBy("_row_id").collect()
    assert [r.icd_code for r in codes] == ["00845", "0389"]
    assert {r.table_name: r.n_rows for r in table_sizes(tables).collect()} == {
        "patients": 3, "admissions": 2, "diagnoses": 2}


def test_csv_bad_number(spark, csv_folder):
    Path(csv_folder, "patients_table.csv").write_text(",subject_id,gender,anchor_age\n0,1,F,old\n")
    with pytest.raises(Exception):
        load_tables(spark, csv_folder).patients.collect()
    assert load_tables(spark, csv_folder, strict=False).patients.first().anchor_age is None


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "patients_table.csv"
    path.write_text(',subject_id,gender,anchor_age\n0,1,"F\nx",40\n1,2,M,50\n')
    got = read_csv_table(spark, str(path), SCHEMAS["patients"], multi_line=True).orderBy("subject_id").collect()
    assert [(r.subject_id, r.gender, r.anchor_age) for r in got] == [(1, "F\nx", 40), (2, "M", 50)]


def test_parquet(spark, folder, tmp_path):
    tables = clinical_tables(spark, folder)
    for name, stem in (("patients", "patients_table"), ("admissions", "patient_admissions"),
                       ("diagnoses", "disease_diagnosis_code")):
        sinks.write_table(getattr(tables, name), f"{tmp_path}/{stem}.parquet", "parquet")
    back = load_tables(spark, str(tmp_path), "parquet")
    assert back.diagnoses.exceptAll(tables.diagnoses.select(back.diagnoses.columns)).count() == 0
    with pytest.raises(ValueError):
        load_tables(spark, str(tmp_path), "orc")


@pytest.mark.parametrize("which", ["compact", "full"])
def test_study(spark, folder, tmp_path, which):
    settings = StudySettings(trees=3, depth=3, max_terms=40, min_group_size=5)
    result = run_study(clinical_tables(spark, folder), which, settings)
    assert [r.Metric for r in result.metric_table.collect()] == [
        "AUC-ROC", "Precision", "Recall", "F1-Score", "LOS RMSE", "LOS MAE", "LOS R²"]
    assert {r.split for r in result.splits.collect()} == {"train", "val", "test"}
    assert result.summary.count() == 1
    assert result.fairness.count() == result.disparity.first().n_groups
    assert set(result.history) == ({"mortality", "los"} if which == "full" else set())
    for chart in result.charts.values():
        assert chart.count() > 0
    paths = write_study(result, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(paths[1])
    assert back.columns[0] == "race_group"


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


# fits of 200 trees take minutes each; tools/check_queries.py compares them too
FITS = {"gbt_mortality", "gbt_los", "training_history", "los_history", "fit_vector_regressor"}


@pytest.mark.parametrize("name", sorted(set(spec.oracle_sql()) - FITS))
def test_query_matches_sql(spark, folder, duck, name):
    ours = spec.queries()[name](spark, folder).toPandas()
    theirs = duck.execute(spec.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert normalized(ours) == normalized(theirs)
    assert len(ours) > 0


def test_entry(spark):
    out = spec.entry(spark)
    assert isinstance(out.limit(5).toPandas(), pd.DataFrame)
    assert set(spec.oracle_sql()) <= set(spec.queries())
