"""A finished study as one folder that a new session can read and score with.

Layout below the folder: ``tables/<name>`` (Parquet, ranked tables with their
``place``), ``models/mortality`` and ``models/los`` (in the library's own form),
``vocabulary`` (terms in index order, with their weights), and ``manifest``,
one row that names the rest. The manifest is written last, and a folder without
one is not read: whatever an interrupted run has left is no study.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.operators import models
from wardloom.operators.features import TfidfModel
from wardloom.plans.study import StudyResult

FORM = 1
_MANIFEST = "form int, profile string, tables array<string>, stop_words array<string>, bigrams boolean, mortality_trees int, los_trees int"


@dataclass(frozen=True)
class StudyBundle:
    profile: str
    tables: dict[str, DataFrame]
    features: TfidfModel
    mortality_model: GBTClassificationModel
    los_model: GBTRegressionModel
    mortality_trees: int
    los_trees: int

    def score(self, rows: DataFrame, text: str = "clinical_text") -> DataFrame:
        """Add ``prob``, ``pred`` and ``los_pred`` to rows with a paragraph, as the study scored its test split."""
        vectors = self.features.transform(rows, text, "features")
        outcome = models.score_first_trees(self.mortality_model, vectors, self.mortality_trees)
        return models.score_first_trees(self.los_model, outcome, self.los_trees).drop("features")


def _tables(result: StudyResult) -> dict[str, DataFrame]:
    named = {
        "cohort": result.cohort, "splits": result.splits, "scored": result.scored, "metrics": result.metric_table,
        "class_report": result.class_report, "fairness": result.fairness, "disparity": result.disparity, "summary": result.summary,
    }
    return named | {f"chart_{k}": v for k, v in result.charts.items()} | {f"history_{k}": v for k, v in result.history.items()}


def write_bundle(result: StudyResult, folder: str) -> str:
    """Write a study; the folder must not exist. Only the vocabulary, bounded by its size, passes through the driver."""
    spark = result.cohort.sparkSession
    named = _tables(result)
    for name, table in named.items():
        table.write.mode("errorifexists").parquet(f"{folder}/tables/{name}")
    result.mortality_model.save(f"{folder}/models/mortality")
    result.los_model.save(f"{folder}/models/los")
    vocabulary = [(i, t, w) for i, (t, w) in enumerate(zip(result.features.terms, result.features.idf))]
    spark.createDataFrame(vocabulary, "place int, term string, idf double").write.parquet(f"{folder}/vocabulary")
    row = (FORM, result.profile, sorted(named), list(result.features.stop_words), result.features.bigrams, result.mortality_trees, result.los_trees)
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{folder}/manifest")
    return folder


def read_bundle(spark: SparkSession, folder: str) -> StudyBundle:
    """Read a written study; raises ``FileNotFoundError`` where there is no whole one."""
    try:
        found = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").collect()
    except AnalysisException as error:
        raise FileNotFoundError(f"no finished study in {folder}") from error
    if len(found) != 1 or found[0]["form"] != FORM:
        raise FileNotFoundError(f"no finished study of form {FORM} in {folder}")
    manifest = found[0]
    words = spark.read.parquet(f"{folder}/vocabulary").orderBy("place").collect()
    features = TfidfModel(tuple(w["term"] for w in words), tuple(w["idf"] for w in words), tuple(manifest["stop_words"]), manifest["bigrams"])
    return StudyBundle(
        manifest["profile"], {name: spark.read.parquet(f"{folder}/tables/{name}") for name in manifest["tables"]}, features,
        GBTClassificationModel.load(f"{folder}/models/mortality"), GBTRegressionModel.load(f"{folder}/models/los"),
        manifest["mortality_trees"], manifest["los_trees"],
    )


def long_form(bundle: StudyBundle) -> DataFrame:
    """``section, place, name, metric, value``: the headline numbers, group table and splits of a study."""
    row = lambda section, place, name, metric, value: F.struct(
        F.lit(section).alias("section"), place.cast("int").alias("place"), name.alias("name"), metric.alias("metric"), value.cast("double").alias("value")
    )
    none = F.lit(None)
    headline = bundle.tables["metrics"].select(row("metrics", none, F.lit("all"), F.col("Metric"), F.col("Value")).alias("r"))
    measures = ("n_samples", "mortality_rate", "auc_roc", "precision", "recall", "f1_score")
    groups = bundle.tables["fairness"].select(F.explode(F.array(
        *[row("fairness", F.col("place"), F.col("race_group"), F.lit(m), F.col(m)) for m in measures]
    )).alias("r"))
    splits = bundle.tables["splits"].select(F.explode(F.array(
        *[row("splits", none, F.col("split"), F.lit(m), F.col(m)) for m in ("n_rows", "label_percent")]
    )).alias("r"))
    return headline.unionAll(groups).unionAll(splits).select("r.*")
