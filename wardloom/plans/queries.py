"""Named queries over the star-schema test tables, one per operator family.

Each takes ``(spark, folder)`` and returns a DataFrame over the whole tables.
Floating-point results are rounded to six places, and arrays are joined to
text, so that they compare cleanly with plain SQL.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.functions import groups as gr
from wardloom.functions import lookups, numeric
from wardloom.functions.times import admission_features
from wardloom.operators import cohort as co
from wardloom.operators import diagnoses as dx
from wardloom.operators import fairness, features, head_training, heads, metrics, models, split
from wardloom.operators.skew import TASK_ROWS, spread
from wardloom.plans import bundle, reports
from wardloom.plans.study import StudySettings, run_study
from wardloom.sources import star_tables as st
from wardloom.sources.clinical import ClinicalTables, load_tables, read_csv_table, read_csv_with_rejects, table_sizes
from wardloom.sources.file_order import with_file_order
from wardloom.sources.sinks import materialized, new_location, rounded, write_table
from wardloom.sources.schemas import SCHEMAS, TABLE_FILES

Query = Callable[[SparkSession, str], DataFrame]

ENCODING_LENGTH = lookups.MAX_LENGTH
ENCODING_WORDS = 30_000

_registered: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registered[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registered)


def _exact(df: DataFrame) -> DataFrame:
    return rounded(df, 6)


def _stamp(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def _text_list(name: str) -> Column:
    return F.array_join(F.transform(name, lambda x: F.coalesce(x.cast("string"), F.lit("null"))), "|").alias(name)


# --- sources -----------------------------------------------------------------


@query
def scan_patients(spark: SparkSession, folder: str) -> DataFrame:
    return st.patients(spark, folder)


@query
def scan_admissions(spark: SparkSession, folder: str) -> DataFrame:
    times = ("admittime", "dischtime")
    df = st.admissions(spark, folder)
    return df.select(*[_stamp(c) if c in times else F.col(c) for c in df.columns])


@query
def scan_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return st.diagnoses(spark, folder)


def _csv_folder(spark: SparkSession, folder: str, only: str | None = None, gap: str | None = None) -> str:
    """The clinical tables (or one) as CSV files with a leading row label; ``gap`` is written for nulls."""
    place = new_location(spark, "csv")
    tables = st.clinical_tables(spark, folder)
    labels = {
        "patients": F.col("subject_id"),
        "admissions": F.col("hadm_id"),
        "diagnoses": F.col("hadm_id") * 1_000_000 + F.col("seq_num"),
    }
    for name, frame in zip(tables._fields, tables):
        if only in (None, name):
            cells = [F.coalesce(F.col(c).cast("string"), F.lit(gap)).alias(c) for c in frame.columns] if gap else frame.columns
            write_table(frame.select(labels[name].alias("label"), *cells), f"{place}/{TABLE_FILES[name]}.csv")
    return place


def _csv_table(spark: SparkSession, folder: str, name: str, gap: str | None = None) -> DataFrame:
    place = _csv_folder(spark, folder, name, gap)
    return read_csv_table(spark, f"{place}/{TABLE_FILES[name]}.csv", SCHEMAS[name])


@query
def load_csv_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return table_sizes(load_tables(spark, _csv_folder(spark, folder)))


@query
def load_csv_admissions(spark: SparkSession, folder: str) -> DataFrame:
    df = _csv_table(spark, folder, "admissions")
    times = ("admittime", "dischtime")
    return df.select(*[_stamp(c) if c in times else F.col(c) for c in df.columns])


@query
def load_csv_diagnoses(spark: SparkSession, folder: str) -> DataFrame:
    return _csv_table(spark, folder, "diagnoses")


@query
def load_csv_patients(spark: SparkSession, folder: str) -> DataFrame:
    return _csv_table(spark, folder, "patients")


@query
def load_csv_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Patients from cells in which gaps are spelled out."""
    return _csv_table(spark, folder, "patients", gap="N/A")


# --- codes -------------------------------------------------------------------


def _coded(spark: SparkSession, folder: str, which: str) -> DataFrame:
    return dx.harmonized(st.diagnoses(spark, folder), which)


@query
def harmonize_full(spark: SparkSession, folder: str) -> DataFrame:
    return _coded(spark, folder, "full")


@query
def harmonize_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _coded(spark, folder, "compact")


@query
def describe_full(spark: SparkSession, folder: str) -> DataFrame:
    return dx.described(_coded(spark, folder, "full"), "full").drop("icd_code", "icd_version")


@query
def describe_compact(spark: SparkSession, folder: str) -> DataFrame:
    return dx.described(_coded(spark, folder, "compact"), "compact").drop("icd_code", "icd_version")


@query
def diagnosis_lists(spark: SparkSession, folder: str) -> DataFrame:
    return dx.diagnosis_lists(st.diagnoses(spark, folder), "full").select(
        "hadm_id", "part", _text_list("diagnosis_codes"), "num_diagnoses"
    )


@query
def diagnosis_list_parts(spark: SparkSession, folder: str) -> DataFrame:
    """The same lists in parts of two codes, so that most admissions have several."""
    return dx.diagnosis_lists(st.diagnoses(spark, folder), "full", part_size=2).select(
        "hadm_id", "part", _text_list("diagnosis_codes"), "num_diagnoses"
    )


@query
def diagnosis_summaries(spark: SparkSession, folder: str) -> DataFrame:
    return dx.diagnosis_summaries(st.diagnoses(spark, folder), "full").select(
        "hadm_id", _text_list("first_codes"), _text_list("diagnosis_wordings"), "num_diagnoses"
    )


# --- cohort ------------------------------------------------------------------


@query
def time_features(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(
        co.time_features(st.admissions(spark, folder), "full").select(
            "hadm_id", "los_days", "admit_hour", "admit_dayofweek", "admit_month", "is_weekend",
            "is_night_admission",
        )
    )


@query
def event_time_features(spark: SparkSession, folder: str) -> DataFrame:
    events = st.star(spark, folder, "events").select("event_id", "ts")
    feats = admission_features(F.col("ts"), F.col("ts"))
    feats.pop("los_days")
    return events.withColumns(feats).drop("ts")


@query
def merged_cohort(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(
        co.merged(st.clinical_tables(spark, folder), "full").select(
            "hadm_id", "subject_id", _stamp("admittime"), _stamp("dischtime"), "hospital_expire_flag",
            "admission_type", "admission_location", "insurance", "marital_status", "race", "gender",
            "anchor_age", "los_days", "admit_hour", "admit_dayofweek", "admit_month", "is_weekend",
            "is_night_admission", _text_list("first_codes"), "num_diagnoses",
        )
    )


@query
def cohort_full(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(co.build_cohort(st.clinical_tables(spark, folder), "full"))


@query
def cohort_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(co.build_cohort(st.clinical_tables(spark, folder), "compact"))


def _paragraphs(spark: SparkSession, folder: str, which: str) -> DataFrame:
    return _exact(
        co.build_cohort(st.clinical_tables(spark, folder), which).select(
            "hadm_id", "los_days", "hospital_expire_flag", "clinical_text"
        )
    )


@query
def clinical_text_full(spark: SparkSession, folder: str) -> DataFrame:
    """Length of stay, label and paragraph of every admission."""
    return _paragraphs(spark, folder, "full")


@query
def clinical_text_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _paragraphs(spark, folder, "compact")


@query
def example_paragraph(spark: SparkSession, folder: str) -> DataFrame:
    return co.first_example(_paragraphs(spark, folder, "full"), "hadm_id")


@query
def cohort_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(co.cohort_profile(co.time_features(st.admissions(spark, folder), "full")))


# --- splits ------------------------------------------------------------------


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.coalesce("hospital_expire_flag", F.lit(0)).alias("hospital_expire_flag")
    return st.admissions(spark, folder).select("hadm_id", "subject_id", flag)


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_split(_labelled(spark, folder))


@query
def patient_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.grouped_split(_labelled(spark, folder), "hospital_expire_flag", "hadm_id", "subject_id").select(
        "hadm_id", "subject_id", "hospital_expire_flag", "split"
    )


@query
def split_profile(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(co.split_profile(split.stratified_split(_labelled(spark, folder))))


@query
def label_split(spark: SparkSession, folder: str) -> DataFrame:
    return split.stratified_split(st.star(spark, folder, "labels").select("doc_id", "quality"), "quality", "doc_id")


# --- groups and metrics ------------------------------------------------------


@query
def race_group_exact(spark: SparkSession, folder: str) -> DataFrame:
    return st.admissions(spark, folder).select("hadm_id", "race", gr.race_group_exact(F.col("race")).alias("race_group"))


@query
def race_group_substring(spark: SparkSession, folder: str) -> DataFrame:
    return st.admissions(spark, folder).select(
        "hadm_id", "race", gr.race_group_substring(F.col("race")).alias("race_group")
    )


@query
def roc_auc(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.roc_auc(st.scored(spark, folder)))


@query
def binary_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.binary_metrics(st.scored(spark, folder)))


@query
def confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(st.scored(spark, folder))


@query
def confusion_chart(spark: SparkSession, folder: str) -> DataFrame:
    return reports.confusion_chart(st.scored(spark, folder))


@query
def class_report(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.class_report(st.scored(spark, folder)))


@query
def label_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report on the real labels: how well ``toxic`` predicts ``quality``."""
    return _exact(metrics.class_report(st.star(spark, folder, "labels"), "quality", "toxic", ("low", "high")))


@query
def log_loss(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.log_loss(st.scored(spark, folder)))


@query
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.regression_metrics(st.scored(spark, folder)))


@query
def metric_table(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(metrics.metric_table(st.scored(spark, folder)))


@query
def write_metrics_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    place = write_table(
        metrics.metric_table(st.scored(spark, folder)), new_location(spark, "metrics"), single_file=True
    )
    return _exact(spark.read.schema("Metric string, Value double").option("header", True).csv(place))


@query
def write_groups_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    groups = fairness.by_size(fairness.group_metrics(st.scored(spark, folder), "compact"))
    place = write_table(groups, new_location(spark, "groups"), single_file=True)
    return _exact(spark.read.schema(groups.schema).option("header", True).csv(place))


# --- fairness and reports ----------------------------------------------------


@query
def fairness_full(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(fairness.group_metrics(st.scored(spark, folder), "full"))


@query
def fairness_compact(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(fairness.by_size(fairness.group_metrics(st.scored(spark, folder), "compact")))


@query
def fairness_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    scored = st.scored(spark, folder)
    return _exact(fairness.by_first_seen(fairness.group_metrics(scored, "full"), scored, "hadm_id", "full"))


@query
def fairness_disparity(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(fairness.disparity(fairness.group_metrics(st.scored(spark, folder), "full")))


@query
def group_metric_long(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(reports.group_chart(fairness.group_metrics(st.scored(spark, folder), "full")))


@query
def residual_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(reports.residual_histogram(st.scored(spark, folder)))


@query
def pred_actual_density(spark: SparkSession, folder: str) -> DataFrame:
    return _exact(reports.pred_actual_density(st.scored(spark, folder)))


@query
def run_summary(spark: SparkSession, folder: str) -> DataFrame:
    scored = st.scored(spark, folder)
    return _exact(reports.run_summary(scored, fairness.disparity(fairness.group_metrics(scored, "full"))))


def _rounds(spark: SparkSession, folder: str) -> DataFrame:
    """A history table: the scored rows dealt into 20 rounds."""
    return st.scored(spark, folder).withColumn("iteration", (F.col("hadm_id") % 20 + 1).cast("int"))


@query
def round_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rounds(spark, folder)
    loss = metrics.log_loss(rows, ["iteration"]).withColumnRenamed("log_loss", "val_loss")
    auc = metrics.roc_auc(rows, ["iteration"]).withColumnRenamed("auc_roc", "val_auc")
    return _exact(reports.history_long(loss.join(auc, "iteration")))


@query
def best_iteration(spark: SparkSession, folder: str) -> DataFrame:
    history = metrics.roc_auc(_rounds(spark, folder), ["iteration"])
    return _exact(models.best_iteration(_exact(history), "auc_roc", largest=True))


# --- text features -----------------------------------------------------------


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(st.star(spark, folder, "documents").select("doc_id", "text", "lang"))


def _dealt_documents(spark: SparkSession, folder: str) -> DataFrame:
    return features.dealt_texts(_documents(spark, folder), "text")


@query
def tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = features.with_terms(_dealt_documents(spark, folder), "text", stop_words=(), bigrams=False)
    return features.term_counts(docs)


@query
def vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return features.vocabulary(features.with_terms(_dealt_documents(spark, folder), "text"))


@query
def vocabulary_by_sketch(spark: SparkSession, folder: str) -> DataFrame:
    """The vocabulary from bounded sketches and a second pass over what can be in it."""
    return features.proven_vocabulary(features.with_terms(_dealt_documents(spark, folder), "text"))


@query
def tfidf(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    return _exact(features.fit_tfidf(docs, "text").weights(docs, "doc_id", "text"))


@query
def tfidf_holdout(spark: SparkSession, folder: str) -> DataFrame:
    """Vocabulary and weights from the training split, applied to the test split."""
    docs = split.stratified_split(_documents(spark, folder), "lang", "doc_id")
    model = features.fit_tfidf(docs.where("split = 'train'"), "text")
    return _exact(model.weights(docs.where("split = 'test'"), "doc_id", "text"))


@query
def encode_fixed_length(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    words = features.fit_word_ids(docs, "text", ENCODING_WORDS)
    coded = features.encode_fixed_length(docs, "text", words, ENCODING_LENGTH)
    return coded.select("doc_id", _text_list("input_ids"), _text_list("attention_mask"))


# --- vectors and heads -------------------------------------------------------


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return st.star(spark, folder, "embeddings")


@query
def softmax_argmax(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings read as logits."""
    logits = F.col("embedding")
    return _exact(
        _vectors(spark, folder).select(
            "vec_id",
            numeric.class_probability(logits).alias("prob"),
            F.array_max(numeric.softmax(logits)).alias("top_prob"),
            numeric.argmax(logits).alias("pred"),
        )
    )


@query
def first_vector(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings read as a sequence of eight-wide vectors."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    return _vectors(spark, folder).select(
        "vec_id",
        F.posexplode(numeric.first_vector(pieces)).alias("place", "value"),
    ).select("vec_id", "place", F.round(F.col("value").cast("double"), 6).alias("value"))


def layer(inputs: int, outputs: int) -> heads.Layer:
    """A layer whose weights follow a plain rule, so SQL can repeat them."""
    i, j = np.meshgrid(np.arange(inputs), np.arange(outputs), indexing="ij")
    return ((i * 31 + j * 17) % 13 - 6) / 50.0, ((np.arange(outputs) * 7) % 5 - 2) / 10.0


@query
def score_head(spark: SparkSession, folder: str) -> DataFrame:
    stack = [layer(64, 256), layer(256, 2)]
    return _exact(heads.classifier_scores(_vectors(spark, folder), "embedding", stack).select("vec_id", "prob", "pred"))


@query
def score_head_los(spark: SparkSession, folder: str) -> DataFrame:
    stack = [layer(64, 256), layer(256, 64), layer(64, 1)]
    return _exact(heads.regressor_scores(_vectors(spark, folder), "embedding", stack).select("vec_id", "los_pred"))


# --- fitted models -----------------------------------------------------------


def _split_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Compact cohort with splits and TF-IDF vectors; the cohort is written once."""
    cohort = materialized(co.build_cohort(st.clinical_tables(spark, folder), "compact"), "cohort")
    rows = split.stratified_split(spread(cohort, TASK_ROWS))
    model = features.fit_tfidf(_part(rows, "train"), "clinical_text")
    return model.transform(rows, "clinical_text")


def _part(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def _finite(name: str) -> Column:
    value = F.col(name)
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 1e300)


@query
def gbt_mortality(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_vectors(spark, folder)
    model = models.fit_mortality(_part(rows, "train"))
    return _exact(
        models.score_mortality(model, _part(rows, "test")).select(
            "hadm_id", "hospital_expire_flag", F.col("prob").between(0, 1).alias("prob_in_range"),
            (F.col("pred") == (F.col("prob") > 0.5).cast("int")).alias("pred_agrees"),
        )
    )


@query
def gbt_los(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_vectors(spark, folder)
    model = models.fit_stay(_part(rows, "train"))
    scored = models.score_stay(model, _part(rows, "test"))
    return _exact(scored.select("hadm_id", "los_days", _finite("los_pred").alias("los_pred_finite")))


def _checked_history(history: DataFrame) -> DataFrame:
    return reports.history_long(history).select("iteration", "series", _finite("value").alias("value_finite"))


@query
def training_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_vectors(spark, folder)
    train, val = _part(rows, "train"), _part(rows, "val")
    model = models.fit_mortality(train)
    return _checked_history(models.mortality_history(model, train, val))


@query
def los_history(spark: SparkSession, folder: str) -> DataFrame:
    rows = _split_vectors(spark, folder)
    train, val = _part(rows, "train"), _part(rows, "val")
    model = models.fit_stay(train)
    return _checked_history(models.stay_history(model, train, val))


@query
def fit_vector_head(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.stratified_split(_vectors(spark, folder), "label", "vec_id")
    model = models.fit_vector_classifier(_part(rows, "train"), "embedding", "label", 10)
    return _exact(
        models.score_vectors(model, _part(rows, "test"), "embedding").select(
            "vec_id", "label", F.col("pred").isin(*range(10)).alias("pred_is_a_label"), F.col("prob").between(0, 1).alias("prob_in_range")
        )
    )


@query
def fit_vector_regressor(spark: SparkSession, folder: str) -> DataFrame:
    rows = split.stratified_split(_vectors(spark, folder), "label", "vec_id")
    model = models.fit_vector_regressor(_part(rows, "train"), "embedding", "label")
    return models.score_vectors(model, _part(rows, "test"), "embedding").select("vec_id", "label", _finite("pred").alias("pred_finite"))


# --- heads fitted epoch by epoch -----------------------------------------------

# Small data needs larger steps than the reference setting of the rate.
HEAD_STEPS = head_training.HeadSettings(epochs=10, rate=0.02)
OUTCOME_SIZES, STAY_SIZES = (64, 256, 2), (64, 256, 64, 1)


def rule_layers(sizes: tuple[int, ...]) -> list[heads.Layer]:
    return [layer(a, b) for a, b in zip(sizes, sizes[1:])]


def _labelled_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors, split by their label, with an outcome and a stay that their first two components give away."""
    rows = split.stratified_split(_vectors(spark, folder).select("vec_id", "embedding", "label"), "label", "vec_id")
    x, y = (F.get("embedding", F.lit(i)).cast("double") for i in (0, 1))
    return rows.withColumns({"high": (x + y > 0).cast("int"), "stay": 5.0 + 4.0 * x - 2.0 * y})


def _fitted_outcome(rows: DataFrame) -> head_training.FittedHead:
    train, val = _part(rows, "train"), _part(rows, "val")
    return head_training.train_head(train, val, "embedding", "high", rule_layers(OUTCOME_SIZES), head_training.CLASSES, HEAD_STEPS)


def _fitted_stay(rows: DataFrame) -> head_training.FittedHead:
    train, val = _part(rows, "train"), _part(rows, "val")
    return head_training.train_head(train, val, "embedding", "stay", rule_layers(STAY_SIZES), head_training.SQUARES, HEAD_STEPS)


@query
def head_history(spark: SparkSession, folder: str) -> DataFrame:
    """Losses and validation AUC of a class head after every epoch, and which epoch is kept."""
    return _exact(_fitted_outcome(_labelled_vectors(spark, folder)).table(spark))


@query
def regressor_history(spark: SparkSession, folder: str) -> DataFrame:
    """Losses and validation error of a regression head after every epoch, and which epoch is kept."""
    return _exact(_fitted_stay(_labelled_vectors(spark, folder)).table(spark))


@query
def head_best_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows scored with the class head's best epoch."""
    rows = _labelled_vectors(spark, folder)
    scored = heads.classifier_scores(_part(rows, "test"), "embedding", _fitted_outcome(rows).layers)
    return _exact(scored.select("vec_id", "high", "prob", "pred"))


@query
def regressor_best_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows scored with the regression head's best epoch."""
    rows = _labelled_vectors(spark, folder)
    return _exact(heads.regressor_scores(_part(rows, "test"), "embedding", _fitted_stay(rows).layers).select("vec_id", "stay", "los_pred"))


# --- models that must find what is there -----------------------------------------

PLANTED_TREES, PLANTED_TOLERANCE, PLANTED_TERMS = 10, 0.05, 200


def _planted(spark: SparkSession, folder: str) -> DataFrame:
    """The compact cohort with an outcome and a stay that words of its paragraphs give away, split, with vectors."""
    text = F.col("clinical_text")
    has = lambda word: text.contains(word).cast("int")
    cohort = co.build_cohort(st.clinical_tables(spark, folder), "compact").select(
        "hadm_id", "clinical_text", has("pneumonia").alias("outcome"), (2.0 + 3.0 * has("sepsis") + 1.5 * has("pneumonia")).alias("stay")
    )
    rows = split.stratified_split(spread(materialized(cohort, "planted"), TASK_ROWS), "outcome")
    return features.fit_tfidf(_part(rows, "train"), "clinical_text", PLANTED_TERMS).transform(rows, "clinical_text")


@query
def gbt_planted_outcome(spark: SparkSession, folder: str) -> DataFrame:
    rows = _planted(spark, folder)
    model = models.fit_mortality(_part(rows, "train"), "outcome", trees=PLANTED_TREES, depth=1)
    return _exact(models.score_mortality(model, _part(rows, "test")).select("hadm_id", "outcome", "prob", "pred"))


@query
def gbt_planted_stay(spark: SparkSession, folder: str) -> DataFrame:
    rows = _planted(spark, folder)
    model = models.fit_stay(_part(rows, "train"), "stay", trees=3, depth=2)
    return _exact(models.score_stay(model, _part(rows, "test")).select("hadm_id", "stay", "los_pred"))


@query
def planted_history(spark: SparkSession, folder: str) -> DataFrame:
    """Losses and validation AUC after every tree."""
    rows = _planted(spark, folder)
    train, val = _part(rows, "train"), _part(rows, "val")
    model = models.fit_mortality(train, "outcome", trees=PLANTED_TREES, depth=1)
    return _exact(reports.history_long(models.mortality_history(model, train, val, "outcome")))


@query
def best_iteration_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Test rows scored by a model that stopped growing when its validation error did."""
    rows = _planted(spark, folder)
    model = models.fit_mortality(_part(rows, "train"), "outcome", trees=6 * PLANTED_TREES, depth=1,
                                 validation=_part(rows, "val"), tolerance=PLANTED_TOLERANCE)
    scored = models.score_mortality(model, _part(rows, "test"))
    return _exact(scored.select("hadm_id", "outcome", "prob", "pred", F.lit(model.getNumTrees).alias("trees")))


# --- the whole study ---------------------------------------------------------------

STUDY = StudySettings(trees=5, depth=2, max_terms=PLANTED_TERMS)


def _planted_tables(spark: SparkSession, folder: str) -> ClinicalTables:
    """The clinical tables, with an outcome and a stay that the admission type decides."""
    tables = st.clinical_tables(spark, folder)
    urgent = F.col("admission_type") == "1-URGENT"
    hours = F.when(urgent, 120).otherwise(48)
    return tables._replace(admissions=tables.admissions.withColumns({
        "hospital_expire_flag": urgent.cast("int"),
        "dischtime": F.when(F.col("dischtime").isNotNull(), F.col("admittime") + F.make_interval(hours=hours)),
    }))


def _study(spark: SparkSession, folder: str, which: str) -> DataFrame:
    place = bundle.write_bundle(run_study(_planted_tables(spark, folder), which, STUDY), new_location(spark, f"study-{which}"))
    return _exact(bundle.long_form(bundle.read_bundle(spark, place)))


@query
def study_compact(spark: SparkSession, folder: str) -> DataFrame:
    """The compact study from tables to report, written as a bundle and read back."""
    return _study(spark, folder, "compact")


@query
def study_full(spark: SparkSession, folder: str) -> DataFrame:
    """The full study from tables to report, written as a bundle and read back."""
    return _study(spark, folder, "full")


@query
def study_rescored(spark: SparkSession, folder: str) -> DataFrame:
    """All admissions scored with the models of a bundle that was read back."""
    tables = _planted_tables(spark, folder)
    place = bundle.write_bundle(run_study(tables, "compact", STUDY), new_location(spark, "study-rescored"))
    cohort = co.build_cohort(tables, "compact").select("hadm_id", "clinical_text")
    return _exact(bundle.read_bundle(spark, place).score(cohort).select("hadm_id", "prob", "pred", "los_pred"))


# --- order of groups ---------------------------------------------------------------


@query
def group_places_by_size(spark: SparkSession, folder: str) -> DataFrame:
    groups = fairness.group_metrics(st.scored(spark, folder), "compact")
    return fairness.placed_by_size(groups).select("place", "race_group", "n_samples")


@query
def group_places_by_first_seen(spark: SparkSession, folder: str) -> DataFrame:
    scored = st.scored(spark, folder)
    groups = fairness.group_metrics(scored, "full")
    return fairness.placed_by_first_seen(groups, scored, "hadm_id", "full").select("place", "race_group", "n_samples")


@query
def write_group_places_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """The order of the written group report: the line each group is on."""
    groups = fairness.by_size(fairness.group_metrics(st.scored(spark, folder), "compact")).select("race_group", "n_samples")
    place = write_table(groups, new_location(spark, "places"), single_file=True)
    read = spark.read.schema(groups.schema).option("header", True).csv(place)
    return read.select((F.monotonically_increasing_id() + 1).cast("int").alias("place"), "race_group", "n_samples")


@query
def group_places_in_files(spark: SparkSession, folder: str) -> DataFrame:
    """Groups by their first row in files that hold the rows backwards and have no row label."""
    place = new_location(spark, "backwards")
    st.scored(spark, folder).orderBy(F.desc("hadm_id")).write.parquet(place)
    scored = with_file_order(spark.read.parquet(place), "line")
    groups = fairness.group_metrics(scored, "full")
    return fairness.placed_by_first_seen(groups, scored, "line", "full").select("place", "race_group", "n_samples")


@query
def file_order(spark: SparkSession, folder: str) -> DataFrame:
    """The line that each admission is on in CSV files that hold them backwards."""
    place = new_location(spark, "lines")
    rows = st.admissions(spark, folder).select("hadm_id", "race").orderBy(F.desc("hadm_id"))
    write_table(rows, place)
    return with_file_order(spark.read.schema("hadm_id long, race string").option("header", True).csv(place), "line")


# --- cells that are not what they should be ------------------------------------------


def _spoilt_csv(spark: SparkSession, folder: str) -> str:
    """Admissions as CSV, with words in some cells of times and flags."""
    place = new_location(spark, "spoilt")
    spoilt = lambda name, every, text: F.when(F.col("hadm_id") % every == 0, F.lit(text)).otherwise(F.col(name).cast("string")).alias(name)
    rows = st.admissions(spark, folder).select(
        F.col("hadm_id").alias("label"), "hadm_id", "subject_id", spoilt("admittime", 13, "last Tuesday"), "dischtime",
        spoilt("hospital_expire_flag", 17, "yes"), "admission_type", "admission_location", "insurance", "marital_status", "race",
    )
    return write_table(rows, f"{place}/{TABLE_FILES['admissions']}.csv")


@query
def load_csv_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Cells that could not be parsed, by row and column."""
    return read_csv_with_rejects(spark, _spoilt_csv(spark, folder), SCHEMAS["admissions"]).rejects.select("row_label", "column_name", "text")


@query
def load_csv_lenient(spark: SparkSession, folder: str) -> DataFrame:
    """The rows beside those cells, with nulls in their place."""
    rows = read_csv_with_rejects(spark, _spoilt_csv(spark, folder), SCHEMAS["admissions"]).rows
    return rows.select("hadm_id", _stamp("admittime"), _stamp("dischtime"), "hospital_expire_flag", "race")


@query
def text_missing_column(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraphs of admissions whose table has no column for where they came from."""
    tables = st.clinical_tables(spark, folder)
    merged = co.merged(tables._replace(admissions=tables.admissions.drop("admission_location")), "full")
    return co.with_text(merged, "full").select("hadm_id", "clinical_text")
