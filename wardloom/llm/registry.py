"""Named queries over the test tables, one for each operator of this subpackage.

Each applies its operator to the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm import decontaminate, html_text, katz, knn_quality, minhash, mixing, oracle, pii, quality_rules, suffix_dedup, token_ids, toxicity, vector_codes, whitening
from wardloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, Query] = {}


def query(function: Query) -> Query:
    _registered[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_registered)


def oracle_sql() -> dict[str, str]:
    """SQL for the contracts that have one; the others are tested against brute force, round trips or held-out labels."""
    return oracle.oracle_sql()


def default_tokenizer() -> str:
    """The public vocabulary that the queries use; elsewhere the path is a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op3_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as token ids in Simple-8b files, read back."""
    return token_ids.tokenized(table(spark, folder, "documents"), default_tokenizer())


@query
def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in every document, by suffix arrays."""
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op2_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return minhash.components(table(spark, folder, "documents"))


@query
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without strings of 100 bytes that start earlier."""
    return suffix_dedup.deduplicated(table(spark, folder, "documents"))


@query
def op7_katz(spark: SparkSession, folder: str) -> DataFrame:
    """log10 probability of every document under a Katz model of four fifths of them."""
    return katz.report(table(spark, folder, "documents"), every_word=True)


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base statistics and likelihood verdict of every document."""
    return quality_rules.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


# Wanted shares of clean, low-quality and toxic tokens.
MIX_WEIGHTS = (0.94, 0.05, 0.01)


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Domain posteriors of every document and the rates that mix them to the wanted shares."""
    return mixing.mixed(table(spark, folder, "documents"), table(spark, folder, "labels"), MIX_WEIGHTS)


@query
def op1_knn_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document by votes of its nearest labelled ones."""
    return knn_quality.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity score of every document by compression distance."""
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page, by differencing pages with near URLs."""
    return html_text.main_texts(table(spark, folder, "pages"))


@query
def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in every document: fixed patterns, and what weakly supervised span classifiers add."""
    return pii.report(table(spark, folder, "documents"))


@query
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Whitened principal components of every vector, by shifted Cholesky QR."""
    return whitening.report(table(spark, folder, "embeddings"))


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product code of every vector, with codebooks from four rounds of member-resident Lloyd."""
    return vector_codes.report(table(spark, folder, "embeddings"))
