"""Mix documents to target weights of domains that each belongs to in part.

A naive Bayes classifier over hashed words, counted on at most ``LABELLED_ROWS``
labelled documents, gives every document a posterior over the domains. With
a[d] = posterior[d] * tokens of a document, its rate r >= 0 (copies expected)
is fitted so that the sums of r * a[d] match the targets: projected gradient
steps from r = 1 on the least squares

    1/2 (y - t)' G^-1 (y - t),   y = sum of r a,   G = sum of a a'.

A step goes along the gradient scaled by the same sum over the rows that are
free to move, those not held at a bound by it. Where that would not lower the
squares the plain gradient is taken, whose Lipschitz constant is 1. Steps end
when the sums match the targets or the squares stand still. Each needs two small
aggregates, of as many numbers as there are domains and pairs of them; a rate
follows from the document's own row and those numbers, so nothing is shuffled.
Every ``CHAIN`` steps the rates are written, as their expression would grow
beyond what compiles. ``max_rate`` bounds the rates above too. With ``hold`` a document whose likeliest domain is the kept one has
rate 1, and only the others are fitted. Targets are first brought into what the
free documents can reach, so that the steps do not pay for what no rate can
give; ``Mix`` has what there was, what was wanted, and what was reached.

DataFrame expressions only. Texts are read twice and not shuffled.

Defined cases: a null or empty text has no tokens, prior posterior and rate 1;
rows that share a doc_id each get their own; a null doc_id is unlabelled;
labels of documents that are not there count for nothing; a domain without
tokens in reach keeps what it has; without labels all domains are equally
likely; an empty table gives an empty result; other columns are kept by
``sampled`` and else ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardloom.llm.common import fresh
from wardloom.llm.native import labelled_sample, words
from wardloom.sources.sinks import materialized

BUCKETS = 1 << 14
LABELLED_ROWS = 20_000
# A text speaks for its domain like one of at most so many words.
VOICE = 64
SCALE = 1 << 20
STEPS = 60
TOLERANCE = 1e-7
STANDSTILL = 1e-6
CHAIN = 8

DOMAINS = ("clean", "low", "toxic")


def domain_of_labels() -> Column:
    """Number in ``DOMAINS`` of a row of labels."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


def _buckets() -> Column:
    return F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int")


@dataclass
class Classifier:
    weights: DataFrame  # bucket, w0, w1, ...: log P(bucket | domain) times SCALE, whole numbers
    unseen: list[int]  # of buckets that no labelled text has
    priors: list[float]


def fit(docs: DataFrame, labels: DataFrame, domain: Column, domains: int, rows: int = LABELLED_ROWS) -> Classifier:
    there = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    sample = materialized(labelled_sample(labels.join(there, labels["doc_id"].cast("long") == there["doc_id"], "left_semi"), domain, rows), "mixing-labels")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    each = texts.select("label", F.explode(words(F.col("text"))).alias("word")).select("label", _buckets().alias("bucket"))
    counts = materialized(
        each.groupBy("bucket").agg(*[F.sum((F.col("label") == d).cast("long")).alias(f"c{d}") for d in range(domains)]), "mixing-counts"
    )
    totals = counts.agg(*[F.coalesce(F.sum(f"c{d}"), F.lit(0)).alias(f"c{d}") for d in range(domains)]).first()
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = sum(seen.values())
    priors = [float(np.log((seen.get(d, 0) + 1) / (size + domains))) for d in range(domains)]
    log_p = lambda c, d: F.round(F.log((c + 1.0) / (totals[f"c{d}"] + BUCKETS)) * SCALE).cast("long")
    weights = counts.select("bucket", *[log_p(F.col(f"c{d}"), d).alias(f"w{d}") for d in range(domains)])
    return Classifier(weights, [int(round(np.log(1 / (totals[f"c{d}"] + BUCKETS)) * SCALE)) for d in range(domains)], priors)


def posteriors(docs: DataFrame, model: Classifier) -> DataFrame:
    """``row`` (number of the row), doc_id, tokens and p0, p1, ... of every document."""
    domains = range(len(model.priors))
    each = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("words"))
        .withColumn("row", F.monotonically_increasing_id())
        .select("row", "doc_id", F.explode_outer("words").alias("word"))
    )
    joined = each.withColumn("bucket", F.when(F.col("word").isNotNull(), _buckets())).join(F.broadcast(model.weights), "bucket", "left")
    sums = joined.groupBy("row", "doc_id").agg(
        F.count("word").alias("tokens"),
        *[F.coalesce(F.sum(F.when(F.col("word").isNotNull(), F.coalesce(f"w{d}", F.lit(model.unseen[d])))), F.lit(0)).alias(f"s{d}") for d in domains],
    )
    n = F.greatest("tokens", F.lit(1))
    voiced = [F.lit(model.priors[d]) + F.col(f"s{d}") / SCALE / n * F.least(n, F.lit(VOICE)) for d in domains]
    logs = sums.select("row", "doc_id", "tokens", *[v.alias(f"v{d}") for d, v in zip(domains, voiced)])
    top = F.greatest(*[F.col(f"v{d}") for d in domains])
    powers = logs.withColumns({f"e{d}": F.exp(F.col(f"v{d}") - top) for d in domains})
    whole = sum((F.col(f"e{d}") for d in domains), F.lit(0.0))
    return powers.select("row", "doc_id", "tokens", *[(F.col(f"e{d}") / whole).alias(f"p{d}") for d in domains])


def _amount(d: int) -> Column:
    return F.col(f"p{d}") * F.col("tokens")


HELD, START = "held", "start"


def rate(steps: Sequence[Sequence[float]], max_rate: float | None) -> Column:
    """The rate of a row some steps after ``start``; one expression without loops, so that it compiles."""
    value = START
    for step in steps:
        move = " + ".join(f"p{d} * ({float(x)!r}D)" for d, x in enumerate(step))
        value = f"greatest(0.0D, {value} - ({move}) * tokens)"
        if max_rate is not None:
            value = f"least({float(max_rate)!r}D, {value})"
    return F.when(F.col(HELD), F.lit(1.0)).otherwise(F.expr(value))


def _sums(found: DataFrame, values: dict[str, Column]) -> list[float]:
    return list(found.agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(k) for k, v in values.items()]).first())


@dataclass
class Mix:
    steps: int
    had: list[float]  # tokens expected of each domain before, and after
    wanted: list[float]
    target: list[float]  # what is wanted, as far as it can be reached
    reached: list[float]


def fit_rates(found: DataFrame, wanted: Sequence[float], max_rate: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE) -> tuple[DataFrame, Mix]:
    """Add the ``rate`` to which projected gradient steps lead from 1 to the wanted sums; ``found`` has tokens, p0, p1, ... and held."""
    domains = range(len(wanted))
    free = ~F.col(HELD)
    first = _sums(found, {f"y{d}": _amount(d) for d in domains} | {f"f{d}": F.when(free, _amount(d)) for d in domains})
    had, movable = np.array(first[: len(wanted)]), np.array(first[len(wanted) :])
    gram = _gram(found.where(free), domains)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    most = np.inf if max_rate is None else had - movable + max_rate * movable
    target = np.where(movable > 0, np.clip(np.array(wanted, float), had - movable, most), had)
    scale = max(float(np.abs(target).max(initial=0)), 1e-300)
    squares = lambda y: float((y - target) @ inverse @ (y - target)) / 2
    names = found.columns
    found = found.withColumn(START, F.lit(1.0))
    chain: list[list[float]] = []

    def reached_by(step: np.ndarray) -> np.ndarray:
        now = found.select(rate([*chain, step.tolist()], max_rate).alias("r"), *names)
        return np.array(_sums(now, {f"y{d}": F.col("r") * _amount(d) for d in domains}))

    done, y = 0, had
    while done < steps and np.abs(y - target).max(initial=0) > tolerance * scale:
        if len(chain) == CHAIN:
            found = materialized(found.select(*names, rate(chain, max_rate).alias(START)), "mixing-rates")
            chain = []
        slope = inverse @ (y - target)
        step = np.linalg.pinv(_gram(_movable(found.select(rate(chain, max_rate).alias("r"), *names), slope, max_rate), domains), rcond=1e-10, hermitian=True) @ (y - target)
        now = reached_by(step)
        if squares(now) > squares(y):
            step = slope
            now = reached_by(step)
        chain.append(step.tolist())
        done += 1
        before, y = y, now
        if squares(before) - squares(y) <= STANDSTILL * squares(before):
            break
    mix = Mix(done, had.tolist(), [float(w) for w in wanted], target.tolist(), y.tolist())
    return found.select(*names, rate(chain, max_rate).alias("rate")), mix


def _movable(found: DataFrame, slope: np.ndarray, max_rate: float | None) -> DataFrame:
    """Rows that are not held, by a bound of their rate ``r`` or at all, against the slope."""
    down = F.expr("(" + " + ".join(f"p{d} * ({float(x)!r}D)" for d, x in enumerate(slope)) + ") * tokens")
    stuck = (F.col("r") <= 0) & (down > 0)
    if max_rate is not None:
        stuck = stuck | ((F.col("r") >= max_rate) & (down < 0))
    return found.where(~F.col(HELD) & ~stuck)


def _gram(found: DataFrame, domains: Sequence[int]) -> np.ndarray:
    pairs = [(i, j) for i in domains for j in domains if i <= j]
    out = np.zeros((len(domains), len(domains)))
    for (i, j), g in zip(pairs, _sums(found, {f"g{i}_{j}": _amount(i) * _amount(j) for i, j in pairs})):
        out[i, j] = out[j, i] = g
    return out


def totals(found: DataFrame, domains: int) -> list[float]:
    return _sums(found, {f"y{d}": _amount(d) for d in range(domains)})


def targets_for(have: Sequence[float], weights: Sequence[float], kept: int) -> list[float]:
    """Targets in proportion to ``weights`` at which domain ``kept`` stays as large as it is."""
    return [have[kept] * w / weights[kept] for w in weights]


def summary(spark: SparkSession, mix: Mix, names: Sequence[str] = DOMAINS) -> DataFrame:
    """``domain, had, wanted, target, reached`` in tokens, a row for each domain."""
    rows = [(names[d] if d < len(names) else str(d), *values) for d, values in enumerate(zip(mix.had, mix.wanted, mix.target, mix.reached))]
    return spark.createDataFrame(rows, "domain string, had double, wanted double, target double, reached double")


def copies(r: Column) -> Column:
    """Whole copies of a row: its rate rounded up or down by a hash of its id, in expectation the rate."""
    share = F.pmod(F.xxhash64(F.lit("copies"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + (share < r - F.floor(r)).cast("long")).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, weights: Sequence[float], kept: int = 0, max_rate: float | None = None,
           hold: bool = False) -> tuple[DataFrame, Mix]:
    """Posteriors and rate of every document, and the mix fitted to them."""
    domains = range(len(weights))
    found = posteriors(docs, fit(docs, labels, domain_of_labels(), len(weights)))
    likeliest = F.col(f"p{kept}") >= F.greatest(F.lit(0.0), *[F.col(f"p{d}") for d in domains])
    found = materialized(found.withColumn(HELD, likeliest if hold else F.lit(False)), "mixing-posteriors")
    return fit_rates(found, targets_for(totals(found, len(weights)), weights, kept), max_rate)


def mixed(docs: DataFrame, labels: DataFrame, weights: Sequence[float], kept: int = 0, max_rate: float | None = None,
          hold: bool = False) -> DataFrame:
    """doc_id, tokens, posteriors p0, ..., rate and copies of every document, and the targets and sums of the whole mix."""
    found, mix = fitted(docs, labels, weights, kept, max_rate, hold)
    names = [f"p{d}" for d in range(len(weights))]
    whole = [F.lit(v).alias(f"{name}{d}") for name, values in (("target", mix.target), ("reached", mix.reached)) for d, v in enumerate(values)]
    return found.select("doc_id", "tokens", *names, "rate", copies(F.col("rate")).alias("copies"), *whole)


def sampled(docs: DataFrame, labels: DataFrame, weights: Sequence[float], kept: int = 0, max_rate: float | None = 1.0,
            hold: bool = True) -> DataFrame:
    """``docs`` mixed: each row as often as its copies say. Rows that share a doc_id share their largest number of copies.

    What was wanted and reached is written beside the other scratch tables, as ``mixing-summary``.
    """
    found, mix = fitted(docs, labels, weights, kept, max_rate, hold)
    materialized(summary(docs.sparkSession, mix), "mixing-summary")
    number = fresh(docs.columns, "copies")
    numbered = found.select("doc_id", copies(F.col("rate")).alias("copies"))
    changed = numbered.where("copies <> 1 and doc_id is not null").groupBy("doc_id").agg(F.max("copies").alias(number))
    key = fresh([*docs.columns, number], "mixed_id")
    joined = docs.join(changed.withColumnRenamed("doc_id", key), docs["doc_id"].cast("long") == F.col(f"`{key}`"), "left")
    times = F.coalesce(F.col(f"`{number}`"), F.lit(1))
    each = fresh([*docs.columns, number, key], "copy")
    some = joined.where(times > 0).withColumn(each, F.explode(F.sequence(F.lit(1), times)))
    return some.select(*[F.col(f"`{c}`") for c in docs.columns])
