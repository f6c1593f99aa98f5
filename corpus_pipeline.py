"""A training corpus from raw documents, in five stages.

    python corpus_pipeline.py SF_DIR [OUT]

Each stage reads what the one before has written and works on all of it. A
stage takes (spark, docs, sf_dir) and returns documents with their columns;
the last returns the digests of the token-id files that it writes.

The quality and mixing stages learn from the given labels of the documents
that they see; a document dropped by one stage is not in the next. Null texts,
repeated rows and other columns are as each operator defines.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from wardloom.llm import decontaminate, knn_quality, minhash, mixing, token_ids
from wardloom.llm.common import table
from wardloom.llm.registry import MIX_WEIGHTS, default_tokenizer
from wardloom.sources.sinks import materialized


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the neighbour votes take for good ones."""
    return knn_quality.without_low_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each near-duplicate component."""
    return minhash.without_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents thinned so that the clean share of tokens comes up to its weight; none is repeated."""
    return mixing.sampled(docs, table(spark, sf_dir, "labels"), MIX_WEIGHTS, max_rate=1.0)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id files, read back."""
    return token_ids.tokenized(docs, default_tokenizer())


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing", mixed),
    ("token ids", encoded),
]
# votes, components and vocabularies are beyond SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


if __name__ == "__main__":
    session = SparkSession.builder.appName("corpus pipeline").getOrCreate()
    result = run(session, sys.argv[1])
    if len(sys.argv) > 2:
        result.write.parquet(sys.argv[2])
    else:
        result.show()
