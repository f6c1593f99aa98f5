"""Order of files, rejected cells, study bundles."""

import shutil

import pytest
from pyspark.sql import functions as F

from wardloom.operators import fairness
from wardloom.plans import bundle
from wardloom.plans.study import StudySettings, run_study
from wardloom.sources.clinical import load_tables, read_csv_table, read_csv_with_rejects, read_parquet_table
from wardloom.sources.file_order import with_file_order
from wardloom.sources.schemas import ADMISSIONS
from wardloom.sources.star_tables import clinical_tables


@pytest.mark.parametrize("fmt, split", [("parquet", 2_000), ("csv", 700), ("csv", 1 << 27)])
def test_file_order(spark, tmp_path, fmt, split):
    """Files by path, rows as they stand, however the files are cut into splits and whatever else is in them."""
    expected = []
    for name, low, high in (("a", 500, 900), ("b", 0, 500), ("c", 5000, 5001), ("d", 900, 2500)):
        rows = [(i * 7919 % 10_007, f"row {i} " + "x" * (i % 40)) for i in range(low, high)]
        part = spark.createDataFrame(rows, "k long, text string").coalesce(1)
        (part.write.option("header", True).csv if fmt == "csv" else part.write.option("parquet.block.size", 4096).parquet)(str(tmp_path / name))
        expected += [k for k, _ in rows]
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        reader = spark.read.schema("k long, text string").option("header", True)
        paths = [str(tmp_path / n) for n in "dbca"]
        scan = reader.csv(paths) if fmt == "csv" else reader.parquet(*paths)
        numbered = with_file_order(scan.select("k"), "line")
        assert numbered.columns == ["k", "line"]
        got = {r.line: r.k for r in numbered.collect()}
        assert "Sort" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert [got[i] for i in range(len(expected))] == expected and len(got) == len(expected)


def test_no_files_no_rows(spark, tmp_path):
    spark.createDataFrame([], "k long").write.parquet(str(tmp_path / "none"))
    assert with_file_order(spark.read.parquet(str(tmp_path / "none")), "line").count() == 0


def test_tables_without_labels_get_the_order_of_files(spark, tmp_path):
    rows = [(9, "Z", 1), (9, "A", 2), (9, "M", 3)]
    spark.createDataFrame(rows, "hadm_id long, icd_code string, seq_num int").coalesce(1).write.parquet(str(tmp_path / "dx"))
    from wardloom.sources.schemas import DIAGNOSES, ROW_LABEL

    read = read_parquet_table(spark, str(tmp_path / "dx"), DIAGNOSES, file_order=True)
    assert [(r[ROW_LABEL], r.icd_code) for r in read.orderBy(ROW_LABEL).collect()] == [(0, "Z"), (1, "A"), (2, "M")]
    assert ROW_LABEL not in read_parquet_table(spark, str(tmp_path / "dx"), DIAGNOSES).columns


def test_rejects(spark, tmp_path):
    lines = [",hadm_id,admittime,hospital_expire_flag,race,other", "1,10,2020-01-01 00:00:00,1.0,WHITE,x", "2,ten,yesterday,,ASIAN,x", "x,12,NaN,2.5,,x", "4,13,2020-13-01,0,OTHER,x"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    typed, rejects = read_csv_with_rejects(spark, str(tmp_path / "a.csv"), ADMISSIONS)
    assert sorted((r.row_label is None, r.row_label, r.column_name, r.text) for r in rejects.collect()) == [
        (False, 2, "admittime", "yesterday"), (False, 2, "hadm_id", "ten"), (False, 4, "admittime", "2020-13-01"),
        (True, None, "_row_id", "x"), (True, None, "hospital_expire_flag", "2.5")]
    assert all(r.file.endswith("a.csv") for r in rejects.collect())
    lenient = read_csv_table(spark, str(tmp_path / "a.csv"), ADMISSIONS, strict=False)
    assert typed.columns == lenient.columns and sorted(typed.collect(), key=str) == sorted(lenient.collect(), key=str)


@pytest.fixture(scope="module")
def study(spark):
    tables = clinical_tables(spark, "/root/testdata/sf0.001")
    return tables, {which: run_study(tables, which, StudySettings(trees=2, depth=2, max_terms=40, min_group_size=1)) for which in ("compact", "full")}


@pytest.mark.parametrize("which", ["compact", "full"])
def test_bundle(spark, study, tmp_path, which):
    """A bundle read back scores as the study did, and has its tables."""
    _, results = study
    result = results[which]
    place = bundle.write_bundle(result, str(tmp_path / "b"))
    read = bundle.read_bundle(spark, place)
    assert read.profile == which and set(read.tables) >= {"cohort", "scored", "metrics", "fairness", "splits"}
    assert ("history_mortality" in read.tables) == (which == "full")
    again = read.score(result.cohort).select("hadm_id", F.round("prob", 9).alias("prob"), F.round("los_pred", 9).alias("los_pred"))
    stored = read.tables["scored"].select("hadm_id", F.round("prob", 9).alias("prob"), F.round("los_pred", 9).alias("los_pred"))
    assert stored.count() > 0 and stored.exceptAll(again).count() == 0
    assert sorted(r.place for r in read.tables["fairness"].collect()) == list(range(1, read.tables["fairness"].count() + 1))
    assert bundle.long_form(read).where("section = 'metrics'").count() == 7
    with pytest.raises(Exception):
        bundle.write_bundle(result, place)  # never over another


def test_interrupted_bundle_is_not_read(spark, study, tmp_path):
    _, results = study
    place = bundle.write_bundle(results["compact"], str(tmp_path / "b"))
    shutil.rmtree(f"{place}/manifest")
    with pytest.raises(FileNotFoundError):
        bundle.read_bundle(spark, place)
    with pytest.raises(FileNotFoundError):
        bundle.read_bundle(spark, str(tmp_path / "nothing"))


def test_places(spark):
    groups = spark.createDataFrame([("White", 5), ("Asian", 9), ("Black", 5)], "race_group string, n_samples long")
    assert [(r.place, r.race_group) for r in fairness.placed_by_size(groups).orderBy("place").collect()] == [(1, "Asian"), (2, "Black"), (3, "White")]
    scored = spark.createDataFrame([("WHITE", 7), ("ASIAN", 9), ("BLACK/AFRICAN AMERICAN", 8), ("WHITE", 30)], "race string, line long")
    seen = fairness.placed_by_first_seen(groups, scored, "line", "full")
    assert [(r.place, r.race_group) for r in seen.orderBy("place").collect()] == [(1, "White"), (2, "Black"), (3, "Asian")]


def test_load_tables_in_file_order(spark, study, tmp_path):
    tables, _ = study
    for name, stem in (("patients", "patients_table"), ("admissions", "patient_admissions"), ("diagnoses", "disease_diagnosis_code")):
        getattr(tables, name).write.parquet(str(tmp_path / f"{stem}.parquet"))
    read = load_tables(spark, str(tmp_path), "parquet", file_order=True)
    assert all("_row_id" in t.columns for t in read)
    n = read.admissions.count()
    assert sorted(r[0] for r in read.admissions.select("_row_id").collect()) == list(range(n))
