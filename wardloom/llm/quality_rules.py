"""Quality rules: text statistics, and likelihood under trusted text against the corpus.

Words and pairs of words of a text are hashed into ``BUCKETS`` buckets. Two
multinomials over them are counted: one over all trusted documents, one over
all documents. A document's score is the mean log-ratio of
the two over its n-grams, so it does not depend on the length. It is kept if
its score, in steps of 1 / ``STEPS``, is at least that below which ``LOSS`` of
the trusted documents lie, and if the base rules do not fail it.

Log-ratios are whole numbers (times ``SCALE``), so that sums, and with them
every verdict, are the same whatever the order of the rows. DataFrame
expressions only. Texts are shuffled once, by id, where there are too many
trusted ids to broadcast, else never.

Defined cases: a null or empty text has no words, score 0 and fails the base
rules; rows that share a doc_id each get their own result; a document without
id is never trusted; without trusted documents the threshold is the lowest
possible; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardloom.llm.native import WHITE, labelled, long_sum, positions, words
from wardloom.sources.sinks import materialized

BUCKETS = 1 << 16
LOSS = 0.01
STEPS = 200
SCALE = 1 << 20
WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
LOWEST = -(1 << 30)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(texts: DataFrame) -> DataFrame:
    return (
        texts.withColumn("words", words(F.col("text")))
        .withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    )


def _run_hash(start: Column, n: int) -> Column:
    """Hash of ``n`` hashes from a 1-based place, as that of their slice, which would be copied for each place."""
    return F.xxhash64(*[F.get("hashes", start + (k - 1)) for k in range(n)])


def _grams() -> Column:
    """Buckets of the words and of the pairs of words."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS)).cast("int")
    pairs = F.transform(positions(F.size("hashes") - 1), lambda i: bucket(_run_hash(i, 2)))
    return F.concat(F.transform("hashes", bucket), pairs)


def with_base(hashed: DataFrame) -> DataFrame:
    """Add the base statistics, all long, to a frame with text, words and hashes."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    windows = F.transform(positions(F.size("hashes") - (WINDOW - 1)), lambda i: _run_hash(i, WINDOW))
    placed = F.array_sort(F.transform("_windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    same = lambda x, j: F.coalesce(F.get("_placed", j)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("_placed", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    covered = F.transform("_starts", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - x, F.lit(WINDOW))))
    return (
        hashed.withColumn("_lines", lines)
        .withColumn("_windows", windows)
        # most texts have no window twice; only the others are sorted
        .withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed))
        .withColumn("_starts", F.when(F.col("_placed").isNotNull(), starts))
        .withColumns({
            "n_words": F.size("words").cast("long"),
            "word_chars": F.length(F.array_join("words", "")).cast("long"),
            "n_symbols": F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(F.col("_starts").isNull(), F.lit(0).cast("long")).otherwise(long_sum(covered)),
        })
        .drop("_lines", "_windows", "_placed", "_starts")
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, ratio) of at most ``BUCKETS`` rows; ``trusted`` has the doc_ids, each once."""
    marked = _hashed(_texts(docs).join(trusted.select("doc_id", F.lit(1).alias("trusted")), "doc_id", "left"))
    counts = (
        marked.select(F.explode(_grams()).alias("bucket"), "trusted")
        .groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("trusted"))
    )
    counts = materialized(counts, "quality-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).first()
    raw, own = total["raw"] or 0, total["trusted"] or 0
    # the trusted share of each bucket leans on the corpus as much as one n-gram per bucket
    target = (F.col("trusted") + F.col("raw") * (BUCKETS / max(raw, 1))) / (own + BUCKETS)
    ratio = F.log(target / (F.col("raw") / max(raw, 1)))
    return counts.select("bucket", F.round(ratio * SCALE).cast("long").alias("ratio"))


def scored(docs: DataFrame, ratios: DataFrame) -> DataFrame:
    """doc_id, the base statistics and ``step``, the score in whole steps; one row for each row."""
    grams = with_base(_hashed(_texts(docs))).select("doc_id", *BASE, _grams().alias("grams")).withColumn("row", F.monotonically_increasing_id())
    each = grams.select("row", "doc_id", *BASE, F.explode_outer("grams").alias("bucket"))
    sums = (
        each.join(F.broadcast(ratios), "bucket", "left").groupBy("row", "doc_id", *BASE)
        .agg(F.coalesce(F.sum("ratio"), F.lit(0)).alias("ratio"), F.count("bucket").alias("n"))
    )
    mean = F.when(F.col("n") > 0, F.col("ratio") / (F.col("n") * SCALE)).otherwise(0.0)
    return sums.select("doc_id", *BASE, mean.alias("score"), F.floor(mean * STEPS).cast("long").alias("step"))


def threshold(found: DataFrame, trusted: DataFrame, loss: float = LOSS) -> int:
    """The highest step with at most ``loss`` of the trusted documents below it."""
    steps = found.join(trusted, "doc_id", "left_semi").groupBy("step").agg(F.count(F.lit(1)).alias("n"))
    below = 0
    rows = sorted(steps.collect())  # a log-ratio has few hundred steps
    allowed = loss * sum(r["n"] for r in rows)
    for r in rows:
        if below + r["n"] > allowed:
            return r["step"]
        below += r["n"]
    return LOWEST


def report(docs: DataFrame, labels: DataFrame, loss: float = LOSS) -> DataFrame:
    """doc_id, the base statistics, base_failed, score and kept; trusted are all documents of label quality 1."""
    good = labelled(labels, F.when(F.col("quality") == 1, 1)).select("doc_id")
    trusted = materialized(good, "quality-trusted")
    found = materialized(scored(docs, log_ratios(docs, trusted)), "quality-scores")
    least = threshold(found, trusted, loss)
    return found.select(
        "doc_id", *BASE, base_failed().alias("base_failed"), "score", (~base_failed() & (F.col("step") >= least)).alias("kept")
    )
