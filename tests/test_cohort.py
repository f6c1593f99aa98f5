from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wardloom.functions.groups import race_group
from wardloom.functions.times import parsed_time
from wardloom.operators import cohort as co
from wardloom.operators import diagnoses as dx
from wardloom.operators import skew
from wardloom.sources import schemas
from wardloom.sources.clinical import ClinicalTables


def admissions(rows, data):
    return rows(data, schemas.ADMISSIONS)


def adm(hadm, subject, admit=None, leave=None, flag=None, **more):
    values = dict(admission_type="URGENT", admission_location="CLINIC", insurance="Medicare",
                  marital_status="SINGLE", race="WHITE") | more
    return (hadm, subject, admit, leave, None, values["admission_type"], values["admission_location"],
            values["insurance"], values["marital_status"], values["race"], flag)


def test_time_edges(rows, spark):
    moments = [datetime(2024, 3, 8, 21, 59), datetime(2024, 3, 9, 22, 0), datetime(2024, 3, 10, 6, 59),
               datetime(2024, 3, 11, 7, 0), None]
    df = admissions(rows, [adm(i, 1, m, datetime(2024, 3, 12) if m else None) for i, m in enumerate(moments)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):  # the second has a clock change on 10 March
            spark.conf.set("spark.sql.session.timeZone", name)
            got = co.time_features(df).orderBy("hadm_id").collect()
            assert [r.is_night_admission for r in got] == [0, 1, 1, 0, 0]
            assert [r.is_weekend for r in got] == [0, 1, 1, 0, 0]
            assert [r.admit_dayofweek for r in got] == [4, 5, 6, 0, None]
            assert [r.admit_hour for r in got] == [21, 22, 6, 7, None]
            expected = [(datetime(2024, 3, 12) - m).total_seconds() / 86400 if m else None for m in moments]
            assert [r.los_days for r in got] == expected
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_stay_may_be_negative_and_fractional(rows):
    df = admissions(rows, [adm(1, 1, datetime(2024, 1, 2), datetime(2024, 1, 1, 12, 0, 0, 250000))])
    assert co.time_features(df).first().los_days == pytest.approx(-(43200 - 0.25) / 86400, abs=1e-15)


def test_parsed_time(rows):
    df = rows([("2180-05-06 22:23:00",), ("later",)], "t string")
    assert df.select(parsed_time(F.col("t"), strict=False)).collect()[1][0] is None
    with pytest.raises(Exception):
        df.select(parsed_time(F.col("t"))).collect()



RACES = {
    "full": {"white": "White", "WHITE - RUSSIAN": "Other", None: "Other", "UNABLE TO OBTAIN": "Unknown",
             "PATIENT DECLINED TO ANSWER": "Unknown", "asian - korean": "Asian", "CAUCASIAN": "Other",
             "BLACK/CAPE VERDEAN": "Other", "HISPANIC OR LATINO": "Hispanic"},
    "compact": {"WHITE - RUSSIAN": "White", "CAUCASIAN": "Asian", None: "Other",
                "PATIENT DECLINED TO ANSWER": "Other", "unable to obtain": "Unknown", "African": "Black",
                "LATINO WHITE": "White", "SOUTH LATINO": "Hispanic"},
}


@pytest.mark.parametrize("which", ["full", "compact"])
def test_race_groups(rows, which):
    df = rows([(r,) for r in RACES[which]], "race string")
    got = {r.race: r.g for r in df.select("race", race_group(F.col("race"), which).alias("g")).collect()}
    assert got == RACES[which]


def tables(rows):
    patients = rows([(1, "F", 65), (2, "X", None)], schemas.PATIENTS)
    adms = admissions(rows, [
        adm(10, 1, datetime(2024, 3, 9, 23), datetime(2024, 3, 12, 23), 1),
        adm(11, 2, datetime(2024, 3, 11, 12), None, None, race=None, marital_status=None),
        adm(12, 3, None, None, 0),
    ])
    codes = [("4280", 9), ("0389", 9), ("4281", 9), ("4280", 9), ("2959", 9), ("486", 9), ("5849", 9),
             ("25000", 9), ("5990", 9), ("4019", 9), ("99591", 9), ("2930", 9)]
    lines = [(10, i + 1, c, v) for i, (c, v) in enumerate(codes)] + [(11, 1, None, 10), (11, None, None, 9)]
    diagnoses = rows(lines, schemas.DIAGNOSES)
    return ClinicalTables(patients, adms, diagnoses)


def test_paragraphs_full(rows):
    got = {r.hadm_id: r for r in co.build_cohort(tables(rows), "full").collect()}
    assert got[10].clinical_text == (
        "Patient is a 65 year old female of white ethnicity. \n"
        "Admission type: urgent from clinic. \n"
        "Insurance: medicare. Marital status: single.\n"
        "Admitted on a weekend during night hours.\n"
        "Number of diagnoses: 12.\n"
        "Primary diagnoses include: heart failure, bacterial infection, cardiac arrhythmia, diagnosis code F295, pneumonia, "
        "acute kidney injury, diabetes."
    )
    assert got[11].clinical_text == (
        "Patient is a nan year old unknown gender of nan ethnicity. \n"
        "Admission type: urgent from clinic. \n"
        "Insurance: medicare. Marital status: nan.\n"
        "Admitted on a weekday during day hours.\n"
        "Number of diagnoses: 1.\n"
        "Primary diagnoses include: diagnosis code nan, diagnosis code UNK_nan."
    )
    assert got[12].clinical_text.endswith("Number of diagnoses: 0.\nPrimary diagnoses include: no documented diagnoses.")
    assert [got[i].hospital_expire_flag for i in (10, 11, 12)] == [1, 0, 0]
    assert got[12].los_days is None


def test_cohort_compact_drops_unknown_stay(rows):
    got = co.build_cohort(tables(rows), "compact").collect()
    assert [r.hadm_id for r in got] == [10]
    assert len(got[0]) == 9
    assert "diagnosis_UNK" in got[0].clinical_text and "female" in got[0].clinical_text


def test_missing_columns_read_unknown(rows):
    df = rows([(1,)], "hadm_id long")
    text = co.with_text(df, "full").first().clinical_text
    assert text.startswith("Patient is a unknown year old unknown gender of unknown ethnicity.")
    assert "Number of diagnoses: 0." in text and "weekday during day" in text


def test_null_code_row_changes_no_other_row(rows):
    base = tables(rows)
    extra = base._replace(diagnoses=base.diagnoses.unionAll(rows([(12, 1, None, 9)], schemas.DIAGNOSES)))
    a = {r.hadm_id: r for r in co.build_cohort(base).collect()}
    b = {r.hadm_id: r for r in co.build_cohort(extra).collect()}
    assert a[10] == b[10] and a[11] == b[11] and a[12] != b[12]


def test_lists_keep_file_order_and_null_codes(rows):
    data = [(3, 1, 1, "4280", 9), (1, 1, 3, None, 10), (2, 1, 2, "486", 9), (4, None, 1, "486", 9)]
    df = rows(data, "_row_id long, hadm_id long, seq_num int, icd_code string, icd_version int")
    got = dx.diagnosis_lists(df).collect()
    assert [(r.hadm_id, r.diagnosis_codes, r.num_diagnoses) for r in got] == [(1, [None, "J18.9", "I50.9"], 3)]
    by_sequence = dx.diagnosis_lists(df, order_by="seq_num").first().diagnosis_codes
    assert by_sequence == ["I50.9", "J18.9", None]


def test_null_safe_join(rows):
    left = rows([(1, "a"), (None, "b")], "k long, v string")
    right = rows([(1, "x"), (None, "y")], "k long, w string")
    plain = {r.v: r.w for r in co.left_lookup(left, right, "k").collect()}
    safe = {r.v: r.w for r in co.left_lookup(left, right, "k", null_safe=True).collect()}
    assert plain == {"a": "x", "b": None} and safe == {"a": "x", "b": "y"}


def test_duplicate_patients_fan_out(rows):
    base = tables(rows)
    twice = base._replace(patients=base.patients.unionAll(base.patients.where("subject_id = 1")))
    assert co.merged(twice).where("hadm_id = 10").count() == 2


# --- one admission holding a third of all rows --------------------------------


def skewed(spark, n=3000):
    """A third of the rows belong to one admission; sequence numbers shuffled."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500 + 100).cast("long").alias("hadm_id"),
        ((F.col("id") * 7919) % n).cast("int").alias("seq_num"),
        F.format_string("%04d", (F.col("id") * 31) % 9000).alias("icd_code"),
        F.lit(9).alias("icd_version"),
    )


def test_heavy_keys(spark):
    df = skewed(spark)
    assert skew.heavy_keys(df, "hadm_id", min_rows=100) == [7]
    assert skew.heavy_keys(df, "hadm_id") == []


def test_heavy_admission_same_positions(spark):
    df = skewed(spark)
    plain = dx.positioned(df)
    split = dx.positioned(df, min_rows=100)
    assert plain.columns == split.columns
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    heavy = split.where("hadm_id = 7").orderBy("seq_num").select("position").collect()
    assert [r.position for r in heavy] == list(range(1, len(heavy) + 1))


def test_heavy_admission_same_lists(spark):
    df = skewed(spark)
    plain = dx.diagnosis_summaries(df)
    split = dx.diagnosis_summaries(df, min_rows=100)
    assert plain.exceptAll(split).count() == 0
    parts = dx.diagnosis_lists(df, part_size=64, min_rows=100)
    whole = parts.where("hadm_id = 7").orderBy("part").collect()
    assert max(len(r.diagnosis_codes) for r in whole) == 64
    joined = [c for r in whole for c in r.diagnosis_codes]
    assert joined == dx.diagnosis_lists(df).where("hadm_id = 7").first().diagnosis_codes


def test_no_list_is_cut(spark):
    """12,003 codes of one admission: all are in the parts, in order."""
    n = dx.LIST_PART + 2003
    df = spark.range(n).selectExpr("1L as hadm_id", f"cast(id * 7919 % {n} + 1 as int) as seq_num",
                                   f"format_string('X%05d', id * 7919 % {n} + 1) as icd_code", "10 as icd_version")
    parts = dx.diagnosis_lists(df).orderBy("part").collect()
    assert [c for r in parts for c in r.diagnosis_codes] == [f"X{i:05d}" for i in range(1, n + 1)]
    assert sum(r.num_diagnoses for r in parts) == dx.diagnosis_summaries(df).first().num_diagnoses == n
    assert dx.diagnosis_summaries(df).first().first_codes == [f"X{i:05d}" for i in range(1, 11)]


def test_heavy_key_with_null_order(spark):
    df = skewed(spark).withColumn("seq_num", F.when(F.col("seq_num") % 10 > 0, F.col("seq_num")))
    plain, split = dx.positioned(df), dx.positioned(df, min_rows=100)
    columns = ["hadm_id", "seq_num", "position"]
    assert plain.select(columns).exceptAll(split.select(columns)).count() == 0


def test_hot_patient_join_is_split(spark):
    """One patient with a third of all admissions: adaptive execution splits the join."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    n = 300_000
    stamp = F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz")
    adms = spark.range(n).select(
        F.col("id").alias("hadm_id"),
        F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("subject_id"),
        stamp.alias("admittime"), stamp.alias("dischtime"), F.lit("x").alias("race"),
        (F.col("id") % 2).cast("int").alias("hospital_expire_flag"),
    )
    people = spark.range(n).select(F.col("id").alias("subject_id"), F.lit("F").alias("gender"),
                                   F.lit(60).alias("anchor_age"))
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        built = co.merged(ClinicalTables(people, adms, skewed(spark)))
        rows = built.select("hadm_id", "gender", "num_diagnoses")
        assert len(rows.collect()) == n
        assert "skew=true" in rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_ranges_follow_the_groups(spark):
    """Heavy groups whose order values do not overlap, of very different sizes: no range is much above the target."""
    sizes = {1: 6000, 2: 600, 3: 300, 4: 40}
    rows = [(k, float(k * 1_000_000 + (i * 7919) % n)) for k, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "k long, v double").repartition(6)
    cuts = dict(skew.group_cuts(df.where("k < 4"), "k", "v", 100))
    assert {k: len(c) for k, c in cuts.items()} == {1: 59, 2: 5, 3: 2}
    table = spark.createDataFrame(list(cuts.items()), "k long, c array<double>")
    placed = df.join(table, "k").withColumn("r", skew.place_among(F.col("c"), F.col("v")))
    biggest = placed.groupBy("k", "r").count().agg(F.max("count")).first()[0]
    assert biggest <= 150
    assert placed.where("r <> size(filter(c, x -> x <= v))").count() == 0
    numbered = skew.numbered(df, "k", ["v"], F.col("v"), "n", min_rows=100)
    assert numbered.join(skew.numbered(df, "k", ["v"], F.col("v"), "m"), ["k", "v"]).where("n <> m").count() == 0


def test_range_cuts(spark):
    df = spark.range(10_000).select((F.col("id") * 7919 % 10_000).cast("double").alias("v"))
    assert skew.range_cuts(df, "v") == []
    for rows in (5000, 900, 20):
        cuts = skew.range_cuts(df, "v", rows)
        edges = [0, *cuts, 10_000]
        assert abs(len(cuts) + 1 - 10_000 / rows) <= 2 and max(b - a for a, b in zip(edges, edges[1:])) <= 1.6 * rows
    assert skew.range_cuts(df.limit(0), "v", 1) == []
