"""Words and hashed n-grams as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_BETWEEN = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The runs of other characters than ASCII white space; null has none."""
    inside = F.trim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inside == "", F.array().cast("array<string>")).otherwise(F.split(inside, _BETWEEN))


def positions(count: Column) -> Column:
    """1 .. count, empty if that is below 1."""
    return F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))


def long_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc + x)


def labelled(labels: DataFrame, label: Column) -> DataFrame:
    """(doc_id, label) of all labelled documents.

    Of several labels for one document the smallest counts; rows without id or
    label are left out.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label.alias("label"))
    return named.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))


def labelled_sample(labels: DataFrame, label: Column, rows: int) -> DataFrame:
    """At most ``rows`` of :func:`labelled`, the first by a hash of their id: a bound of its own, so it may be broadcast."""
    return labelled(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
