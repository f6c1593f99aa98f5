"""Toxicity by compression distance.

Two zstandard dictionaries are made from at most ``TOXIC_ROWS`` toxic and
``ORDINARY_ROWS`` ordinary labelled documents: one of the windows that toxic
documents have significantly more often, one of the most frequent windows of
ordinary documents. A window is a word (a piece of one over ``WINDOW`` bytes).
It is compressed with either dictionary, between fixed fillers that both
dictionaries have, so that the header costs the same and a short window can
be matched. The margin of a window is how many bytes shorter the toxic
dictionary makes it.

The distinct windows of a whole text give a few statistics: the largest
margins, their mean, and how many windows are above thresholds. The thresholds
are the two of ``LEVELS`` that, on the labelled sample, best tell the documents
with a window above them; a logistic regression on the sample, weighted to the
labels' own proportion, calibrates the statistics to a score between 0 and 1.

Every document is scored in one pass without a shuffle.

Defined cases: a null or empty text has no windows and the statistics 0; rows
that share a doc_id each get their score, and one text of a labelled doc_id is
learned from; rows without id or label are not learned from; without toxic or without ordinary labels every score is the
share of toxic ones (0 without any); an empty table gives an empty result;
other columns are carried along or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import byte_texts, one_text_each, pieces, with_columns_by_batch
from wardloom.llm.native import labelled_sample

TOXIC_ROWS = 3000
ORDINARY_ROWS = 6000
WINDOW = 64
LEVEL = 3
DICTIONARY_BYTES = 1 << 14
MIN_DOCUMENTS = 3
# A toxic window is over so many standard errors and so many times likelier in a toxic document.
SIGNIFICANT = 3.5
TIMES = 4.0
LEVELS = tuple(range(1, 13))
REMEMBERED = 800_000
COUNTING_TASKS = 8

_HEAD = bytes([*range(1, 9), 11, 12, *range(14, 20)])
_TAIL = bytes([*range(20, 32), 127, 1, 127, 2])


def windows(text: bytes) -> set[bytes]:
    """The distinct windows of a text, lower-cased."""
    words = set(text.lower().split())
    if max(map(len, words), default=0) > WINDOW:
        words = {w[i : i + WINDOW] for w in words for i in range(0, len(w), WINDOW)}
    return words


class Dictionaries:
    """Compressors for both kinds of text; remembers the margins of windows."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.contents = toxic, ordinary
        self.margins: dict[bytes, int] = {}
        self._toxic, self._ordinary = map(self._compressor, self.contents)

    def __reduce__(self):
        return Dictionaries, self.contents

    @staticmethod
    def _compressor(content: bytes) -> zstandard.ZstdCompressor:
        dictionary = zstandard.ZstdCompressionDict(content + _TAIL + _HEAD, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=False, write_checksum=False, write_dict_id=False)

    def of(self, found: set[bytes]) -> list[int]:
        known = self.margins
        if len(known) > REMEMBERED:
            known.clear()
        for w in found:
            if w not in known:
                window = _HEAD + b" " + w + b" " + _TAIL
                known[w] = len(self._ordinary.compress(window)) - len(self._toxic.compress(window))
        return [known[w] for w in found]


def statistics(margins: list[int]) -> list[float]:
    """Largest margins and their means, number of windows, and how many are at each of ``LEVELS`` or above."""
    own = np.sort(np.array(margins or [0], np.float64))[::-1]
    return [own[0], own[:3].mean(), own[:8].mean(), own.mean(), len(margins), *((own >= t).sum() for t in LEVELS)]


def features(found: np.ndarray, thresholds: tuple[int, ...]) -> np.ndarray:
    counts = found[:, [5 + LEVELS.index(t) for t in thresholds]]
    n = np.maximum(found[:, 4:5], 1)
    return np.hstack([found[:, :4], np.log1p(found[:, 4:5]), np.log1p(counts), counts[:, :1] / n])


def best_thresholds(found: np.ndarray, toxic: np.ndarray) -> tuple[int, ...]:
    """The two levels that best separate documents with a window at them or above: the largest difference of their shares; equal ones by the lower."""
    present = found[:, 5:] > 0
    gain = present[toxic == 1].mean(axis=0) - present[toxic == 0].mean(axis=0)
    first = np.argsort(-gain, kind="stable")[:2]
    return tuple(sorted(LEVELS[i] for i in first))


@dataclass
class Model:
    dictionaries: Dictionaries
    thresholds: tuple[int, ...]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def scores(self, found: np.ndarray) -> np.ndarray:
        z = np.c_[(features(found, self.thresholds) - self.mean) / self.scale, np.ones(len(found))] @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def calibrate(dictionaries: Dictionaries, found: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> Model:
    """Thresholds, and a weighted logistic regression by Newton steps, lightly regularised."""
    thresholds = best_thresholds(found, toxic)
    own = features(found, thresholds)
    mean, scale = own.mean(axis=0), own.std(axis=0) + 1e-9
    x = np.c_[(own - mean) / scale, np.ones(len(own))]
    ridge = np.diag([1.0] * (x.shape[1] - 1) + [1e-6])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - toxic)) + ridge @ w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, gradient)
    return Model(dictionaries, thresholds, mean, scale, w)


def _counted(sample: DataFrame) -> DataFrame:
    """(window, toxic, ordinary): documents of either kind that have a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                sums: dict[bytes, list[int]] = {}
                for text, toxic in zip(byte_texts(piece.column("text")), piece.column("label").to_pylist()):
                    for w in windows(text):
                        sums.setdefault(w, [0, 0])[1 - toxic] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.binary()), *(pa.array([v[i] for v in sums.values()], pa.int64()) for i in (0, 1))],
                    names=["window", "toxic", "ordinary"],
                )

    counts = sample.select("text", "label").mapInArrow(run, "window binary, toxic long, ordinary long")
    # the sample is bounded, and so is the number of tasks that each send their best windows to the driver
    return counts.repartition(COUNTING_TASKS, "window").groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def _dictionary(rows: list) -> bytes:
    """Windows, the best last: nearest to the text, and cheapest to refer to."""
    return b" ".join([b"", *(bytes(r["window"]) for r in reversed(rows)), b""])[-DICTIONARY_BYTES:]


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of ``labels`` (doc_id, toxic), chosen by a hash of the id."""
    known = labels.where(F.col("toxic").isin(0, 1))
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = labelled_sample(known.where("toxic = 1"), F.col("toxic"), TOXIC_ROWS).union(
        labelled_sample(known.where("toxic = 0"), F.col("toxic"), ORDINARY_ROWS)
    )
    chosen = sample.groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "doc_id", "label").persist()
    size = {r["label"]: r["n"] for r in texts.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    if not n1 or not n0:
        texts.unpersist()
        share = 1.0 if n1 else 0.0
        return Model(Dictionaries(b"", b""), LEVELS[:2], np.zeros(8), np.ones(8), np.array([0.0] * 8 + [80 * share - 40]))
    counts = _counted(texts).persist()
    a, b = F.col("toxic") + 0.5, F.col("ordinary") + 0.5
    ratio = F.log(a / (n1 + 1)) - F.log(b / (n0 + 1))
    likely = counts.withColumn("z", ratio / F.sqrt(1 / a + 1 / b)).where(
        (F.col("toxic") >= MIN_DOCUMENTS) & (F.col("z") >= SIGNIFICANT) & (ratio >= float(np.log(TIMES)))
    )
    limit = DICTIONARY_BYTES // 4
    bad = likely.orderBy(F.col("z").desc(), "window").limit(limit).collect()
    plain = counts.where("ordinary > 0").orderBy(F.col("ordinary").desc(), "window").limit(limit).collect()
    counts.unpersist()
    dictionaries = Dictionaries(_dictionary(bad), _dictionary(plain))
    rows = _statistics(texts, dictionaries, ["doc_id", "label"]).orderBy("doc_id").collect()
    texts.unpersist()
    toxic = np.array([r["label"] for r in rows], np.float64)
    weight = np.where(toxic == 1, total[1] / n1, total[0] / n0)
    weight *= len(rows) / weight.sum()
    return calibrate(dictionaries, np.array([r["statistics"] for r in rows]), toxic, weight)


def _statistics(docs: DataFrame, dictionaries: Dictionaries, keep: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kind = T.StructType([T.StructField("statistics", T.ArrayType(T.DoubleType()))])
    return with_columns_by_batch(docs, "text", kind, lambda c: [[statistics(shared.value.of(windows(t))) for t in byte_texts(c)]], keep)


def scored(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each text as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        own = shared.value
        found = [statistics(own.dictionaries.of(windows(t))) for t in byte_texts(column)]
        return [own.scores(np.array(found)) if found else []]

    return with_columns_by_batch(docs, "text", T.StructType([T.StructField(name, T.DoubleType())]), compute, keep)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held-out labels are not learned from."""
    model = fit(docs, labels.where(~held_out()))
    found = scored(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
