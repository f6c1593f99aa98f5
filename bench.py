"""Headline timings: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Every query runs once to warm up and then BENCH_RUNS times (default 3) with
all rows written to a no-op sink; the median counts. Model fits at their full
settings (200 trees) take minutes each; BENCH_FITS=1 times them too, once each.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from wardloom.plans.queries import queries  # noqa: E402

HEADLINE = (
    "scan_admissions", "harmonize_full", "describe_full", "diagnosis_lists", "merged_cohort",
    "clinical_text_full", "clinical_text_compact", "stratified_split", "binary_metrics", "regression_metrics",
    "class_report", "fairness_full", "residual_histogram", "run_summary", "vocabulary", "tfidf",
    "encode_fixed_length", "softmax_argmax", "score_head", "gbt_planted_outcome", "head_history", "study_compact",
)
FULL_FITS = ("gbt_mortality", "gbt_los")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings: dict[str, float] = {}
    for name in HEADLINE:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    if os.environ.get("BENCH_FITS") == "1":
        timings |= {name: round(once(name), 3) for name in FULL_FITS}
    print(json.dumps({
        "metric": "sum of median seconds over headline queries",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": Path(folder).name.removeprefix("sf"),
        "cpus": int(cpus),
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
