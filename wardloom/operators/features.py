"""Text features: vocabulary, TF-IDF, fixed-length id sequences."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions import lookups
from wardloom.functions.text import tokens, unigrams_and_bigrams, without_stop_words
from wardloom.operators.skew import FEW_SPLITS
from wardloom.sources.sinks import materialized

# Reserved ids of the fixed-length encoding.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
RESERVED = 4

# A vocabulary travels with the tasks; its size is a parameter, kept bounded.
VOCABULARY_LIMIT = 1_000_000


# Bytes of text whose distinct terms one task holds while it counts them.
TASK_BYTES = 32 << 20


def dealt_texts(docs: DataFrame, text: str) -> DataFrame:
    """The text column alone, in partitions of about ``TASK_BYTES`` of text each, for counting terms.

    Splits of a file follow its compressed bytes, so the distinct terms of one
    split may need gigabytes. Smaller inputs than that of one task stay as they are.
    """
    texts = docs.select(text)
    parts = -(-(texts.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0) // TASK_BYTES)
    if parts <= 1:
        return texts
    return texts.repartition(max(parts, min(docs.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)))


def with_terms(docs: DataFrame, text: str, stop_words: Collection[str] | None = None,
               bigrams: bool = True, name: str = "terms") -> DataFrame:
    """Add the array of terms of a text column; a null text has none."""
    stop = lookups.stop_words() if stop_words is None else stop_words
    words = without_stop_words(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), stop)
    if not bigrams:
        return docs.withColumn(name, words)
    staged = docs.withColumn(name, words)
    return staged.withColumn(name, unigrams_and_bigrams(F.col(name)))


def term_counts(docs: DataFrame, terms: str = "terms", whole: bool = False) -> DataFrame:
    """Occurrences and documents per term; with ``whole`` a null term stands for all documents.

    Each document sends its terms once for occurrences and once, made unique
    inside the row, for documents. Both are then summed map-side, so the
    shuffle carries one row per distinct term and task, never one per
    (document, term).
    """
    all_terms = F.struct(F.col(terms).alias("terms"), F.lit(1).alias("n"), F.lit(0).alias("docs"))
    unique = F.struct(F.array_distinct(F.col(terms)).alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("docs"))
    every = F.struct(F.array(F.lit(None).cast("string")).alias("terms"), F.lit(0).alias("n"), F.lit(1).alias("docs"))
    return (
        docs.select(F.inline(F.array(all_terms, unique, *([every] if whole else []))))
        .select(F.explode("terms").alias("term"), "n", "docs")
        .groupBy("term")
        .agg(F.sum("n").alias("n_occurrences"), F.sum("docs").alias("n_docs"))
    )


def vocabulary(docs: DataFrame, terms: str = "terms", max_terms: int = lookups.MAX_TERMS) -> DataFrame:
    """The most frequent terms; equal counts are taken in alphabetical order."""
    if max_terms > VOCABULARY_LIMIT:
        raise ValueError(f"a vocabulary holds at most {VOCABULARY_LIMIT} terms")
    return term_counts(docs, terms).orderBy(F.desc("n_occurrences"), "term").limit(max_terms)


# Counters per bucket of terms in the first sketch, the most that are tried, and the buckets.
COUNTERS, MOST_COUNTERS, BUCKETS = 4096, 1 << 18, 64


def proven_vocabulary(docs: DataFrame, terms: str = "terms", max_terms: int = lookups.MAX_TERMS, counters: int = COUNTERS,
                      most: int = MOST_COUNTERS, buckets: int = BUCKETS) -> DataFrame:
    """The rows of :func:`vocabulary`, for corpora with too many distinct terms to shuffle them all.

    A first pass keeps a heavy-hitter sketch for each bucket of terms: a count
    is at most its estimate, and at least that less 3.5 / counters of the
    bucket's occurrences. The terms that can be among the ``max_terms`` most
    frequent follow from these bounds; a second pass counts only those, exactly.
    If a term that no sketch holds could still be among them, there is another
    first pass with four times the counters, and beyond ``most`` all terms are
    counted. What is shuffled is at most the counters of every task and bucket.
    """
    if max_terms > VOCABULARY_LIMIT:
        raise ValueError(f"a vocabulary holds at most {VOCABULARY_LIMIT} terms")
    each = docs.select(F.explode(terms).alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    while counters <= most:
        sketched = each.groupBy("bucket").agg(
            F.call_function("approx_top_k", F.col("term"), F.lit(counters), F.lit(counters)).alias("top"), F.count("term").alias("n")
        )
        # what a term can have without being listed: nothing if all fitted, else the error or what the last of a full list has
        error = F.when(F.col("n") <= counters, 0).otherwise(F.ceil(3.5 * F.col("n") / counters))
        unseen = F.when(F.size("top") < counters, error).otherwise(F.greatest(error, F.element_at("top", -1)["count"]))
        lists = materialized(sketched.select("top", error.alias("error"), unseen.alias("unseen")), "top-terms")
        held = lists.select(F.inline("top"), "error").select(F.col("item").alias("term"), F.col("count").alias("upper"), (F.col("count") - F.col("error")).alias("lower"))
        least = held.orderBy(F.desc("lower")).limit(max_terms).agg(F.count(F.lit(1)).alias("n"), F.min("lower").alias("least")).first()
        unseen = lists.agg(F.max("unseen")).first()[0] or 0
        whole = least["n"] < max_terms  # all terms are wanted
        bound = 1 if whole else max(1, least["least"])
        if unseen < bound:
            chosen = held.where(F.col("upper") >= bound).select("term")
            wanted = docs.sparkSession.createDataFrame(chosen.limit(buckets * counters).collect(), "term string")
            known = docs.select(F.array_distinct(terms).alias("unique"), F.col(terms).alias("terms"))
            parts = known.select(F.inline(F.array(
                F.struct(F.col("terms").alias("t"), F.lit(1).alias("n"), F.lit(0).alias("docs")),
                F.struct(F.col("unique").alias("t"), F.lit(0).alias("n"), F.lit(1).alias("docs")),
            ))).select(F.explode("t").alias("term"), "n", "docs")
            counted = parts.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("n").alias("n_occurrences"), F.sum("docs").alias("n_docs"))
            return counted.orderBy(F.desc("n_occurrences"), "term").limit(max_terms)
        counters *= 4
    return vocabulary(docs, terms, max_terms)


def smoothed_idf(n_docs, doc_count):
    """ln((1 + n) / (1 + df)) + 1"""
    return F.log((1 + n_docs).cast("double") / (1 + doc_count).cast("double")) + 1.0


@dataclass(frozen=True)
class TfidfModel:
    """Fitted vocabulary with weights; ``terms`` in index order."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    stop_words: tuple[str, ...]
    bigrams: bool

    def transform(self, docs: DataFrame, text: str, name: str = "features") -> DataFrame:
        """Add L2-normalised TF-IDF vectors, row by row and without a shuffle."""
        prepared = with_terms(docs, text, self.stop_words, self.bigrams, "_terms")
        if not self.terms:
            raise ValueError("the vocabulary is empty")
        counter = CountVectorizerModel.from_vocabulary(list(self.terms), "_terms", "_counts")
        weigher = ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="_counts", outputCol="_weighted")
        scaler = Normalizer(p=2.0, inputCol="_weighted", outputCol=name)
        return scaler.transform(weigher.transform(counter.transform(prepared))).select(*docs.columns, name)

    def weights(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """The same vectors as a long ``(key, term, weight)`` table."""
        sparse = F.unwrap_udt("_vector")
        vocabulary_rows = docs.sparkSession.createDataFrame(
            list(enumerate(self.terms)), "term_index int, term string"
        )
        long = (
            self.transform(docs.select(key, text), text, "_vector")
            # the outer form keeps the vector from being computed twice, once
            # to test for emptiness; the join drops its null rows
            .select(key, F.inline_outer(F.arrays_zip(sparse["indices"].alias("term_index"),
                                                     sparse["values"].alias("weight"))))
        )
        # bounded by max_terms
        return long.join(F.broadcast(vocabulary_rows), "term_index").select(key, "term", "weight")


def fit_tfidf(docs: DataFrame, text: str, max_terms: int = lookups.MAX_TERMS,
              stop_words: Collection[str] | None = None, bigrams: bool = True) -> TfidfModel:
    """Learn vocabulary and document weights from (training) documents.

    Only the finished vocabulary, at most ``max_terms`` rows, reaches the
    driver.
    """
    stop = tuple(lookups.stop_words() if stop_words is None else stop_words)
    termed = with_terms(dealt_texts(docs, text), text, stop, bigrams)
    if max_terms > VOCABULARY_LIMIT:
        raise ValueError(f"a vocabulary holds at most {VOCABULARY_LIMIT} terms")
    # one pass: the row of the null term, which comes first, counts the documents
    counted = term_counts(termed, whole=True)
    first = counted.orderBy(F.col("term").isNotNull(), F.desc("n_occurrences"), "term").limit(max_terms + 1)
    n_docs = F.max(F.when(F.col("term").isNull(), F.col("n_docs"))).over(Window.partitionBy())
    rows = [r for r in first.select("term", smoothed_idf(n_docs, F.col("n_docs")).alias("idf")).collect() if r["term"] is not None]
    rows.sort(key=lambda row: row["term"])
    return TfidfModel(tuple(r["term"] for r in rows), tuple(r["idf"] for r in rows), stop, bigrams)


def fit_word_ids(docs: DataFrame, text: str, max_terms: int = 30_000) -> list[str]:
    """Vocabulary of the fixed-length encoding, most frequent word first."""
    termed = with_terms(dealt_texts(docs, text), text, stop_words=(), bigrams=False)
    return [row["term"] for row in vocabulary(termed, "terms", max_terms).collect()]


def encode_fixed_length(docs: DataFrame, text: str, words: list[str],
                        max_length: int = lookups.MAX_LENGTH) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, both ``max_length`` long.

    A start and an end id frame the words; longer texts are cut, shorter ones
    padded. Words get ``RESERVED + rank`` as id. The id lookup runs on whole
    Arrow batches; everything else is built in. Nothing is shuffled.
    """
    if max_length < 2:
        raise ValueError("max_length must leave room for the start and end ids")
    known = docs.sparkSession.sparkContext.broadcast(words)
    unknown, reserved = UNKNOWN, RESERVED

    @F.arrow_udf("array<int>")
    def word_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        index = pa.array(known.value, pa.string())  # once for all batches of a task
        for batch in batches:
            rank = pc.index_in(batch.flatten(), value_set=index)
            ids = pc.fill_null(pc.add(rank, pa.scalar(reserved, pa.int32())), pa.scalar(unknown, pa.int32()))
            lengths = pc.fill_null(pc.list_value_length(batch), 0)
            ends = pc.cumulative_sum(lengths.cast(pa.int32()))
            yield pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), ids)

    shown = F.slice(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), 1, max_length - 2)
    framed = docs.withColumn("_ids", F.concat(F.array(F.lit(START)), word_ids(shown), F.array(F.lit(END))))
    filled = F.size("_ids")
    rest = F.lit(max_length) - filled
    return framed.select(
        *docs.columns,
        F.concat("_ids", F.array_repeat(F.lit(PAD), rest)).alias("input_ids"),
        F.concat(F.array_repeat(F.lit(1), filled), F.array_repeat(F.lit(0), rest)).alias("attention_mask"),
    )
