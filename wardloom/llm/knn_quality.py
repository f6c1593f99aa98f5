"""Quality classifier: votes of the nearest labelled documents in a latent space.

A text becomes counts of *shape trigrams*: bytes are mapped to a few classes
(small letters and all non-ASCII bytes, capitals, digits, white space, line
breaks, each mark on its own), runs of one class count once, and three classes
in a row are a feature; so is a word that repeats the one before. With logarithmic counts, inverse document frequencies
and a truncated singular value decomposition, all fitted on at most
``LABELLED_ROWS`` labelled documents, each text is a vector of ``RANK`` numbers.
Labelled vectors are broadcast; every document's cosines with all of them are
computed exactly, in blocks, and the ``NEIGHBOURS`` nearest vote with the
``POWER``-th power of their cosine as weight.

Every document is scored from its whole text in one pass without a shuffle.

Defined cases: a null or empty text has the zero vector, and like any text
without a similar neighbour it gets the share of label 1; rows that share a
doc_id each get their score, and one text of a labelled doc_id is learned from;
of labelled rows that are equally near (to six decimals) the one with the lesser
doc_id votes; rows without id or label are not learned from; without labels every score is 0.5; an empty table gives an empty result; other
columns are carried along or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import byte_texts, fresh, one_text_each, with_columns_by_batch
from wardloom.llm.native import labelled_sample

LABELLED_ROWS = 4096
RANK = 48
NEIGHBOURS = 25
POWER = 8
CLASSES = 40
FEATURES = CLASSES**3 + 1
BLOCK = 512
SEED = 11


def _classes() -> np.ndarray:
    of = np.zeros(256, np.int64)
    marks = 5
    for c in range(256):
        if c >= 0x80 or 0x61 <= c <= 0x7A:
            of[c] = 0
        elif 0x41 <= c <= 0x5A:
            of[c] = 1
        elif 0x30 <= c <= 0x39:
            of[c] = 2
        elif c == 0x0A:
            of[c] = 3
        elif c <= 0x20 or c == 0x7F:
            of[c] = 4
        else:
            of[c] = marks
            marks += 1
    return of


_CLASS = _classes()


def shape_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of the text and how often it has each: trigrams of its shape, and words that repeat the one before."""
    own = _CLASS[np.frombuffer(text, np.uint8)]
    own = own[np.concatenate([[True], own[1:] != own[:-1]])[: len(own)]]
    words = text.split()
    again = sum(map(eq, words, words[1:]))
    extra = np.full(min(again, 1), CLASSES**3), np.full(min(again, 1), again)
    if len(own) < 3:
        return extra
    grams = (own[:-2] * CLASSES + own[1:-1]) * CLASSES + own[2:]
    if len(grams) > CLASSES**3:
        counts = np.bincount(grams)
        seen = np.flatnonzero(counts)
        counts = counts[seen]
    else:
        seen, counts = np.unique(grams, return_counts=True)
    return np.append(seen, extra[0]), np.append(counts, extra[1])


@dataclass
class Model:
    place: np.ndarray  # trigram -> row of the projection, or -1
    weights: np.ndarray  # inverse document frequency by row
    projection: np.ndarray  # (rows, RANK)
    vectors: np.ndarray  # labelled, of length 1
    labels: np.ndarray
    share: float

    def latent(self, counted: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros((len(counted), self.projection.shape[1]), np.float32)
        for i, (grams, counts) in enumerate(counted):
            rows = self.place[grams]
            known = rows >= 0
            rows = rows[known]
            if len(rows):
                out[i] = (np.log1p(counts[known]) * self.weights[rows]).astype(np.float32) @ self.projection[rows]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        out = np.full(len(vectors), self.share)
        k = min(NEIGHBOURS, len(self.labels))
        for i in range(0, len(vectors) if k else 0, BLOCK):
            cosines = vectors[i : i + BLOCK] @ self.vectors.T
            # cosines equal to six decimals are equal; the labelled row that comes first is the nearer one
            order = np.rint(cosines * 1e6).astype(np.int64) * len(self.labels) - np.arange(len(self.labels))
            near = np.argpartition(-order, k - 1, axis=1)[:, :k]
            weight = np.clip(np.take_along_axis(cosines, near, axis=1), 0, None).astype(np.float64) ** POWER
            total = weight.sum(axis=1)
            votes = (weight * self.labels[near]).sum(axis=1)
            out[i : i + BLOCK] = np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.share)
        return out


def fit_model(counted: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = RANK) -> Model:
    n = len(counted)
    place = np.full(FEATURES, -1, np.int64)
    share = float(labels.mean()) if n else 0.5
    frequency = np.bincount(np.concatenate([g for g, _ in counted]), minlength=FEATURES) if n else np.zeros(FEATURES, np.int64)
    used = np.flatnonzero(frequency >= min(2, n)) if n else np.zeros(0, np.int64)
    place[used] = np.arange(len(used))
    weights = np.log((1 + n) / (1 + frequency[used])) + 1
    matrix = np.zeros((n, len(used)), np.float32)
    for i, (grams, counts) in enumerate(counted):
        rows = place[grams]
        known = rows >= 0
        matrix[i, rows[known]] = np.log1p(counts[known]) * weights[rows[known]]
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
    # truncated decomposition: a random range, sharpened by power steps
    width = min(rank + 8, n, len(used))
    sketch = matrix @ np.random.default_rng(SEED).standard_normal((len(used), width)).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(sketch)
        sketch = matrix @ (matrix.T @ basis)
    basis, _ = np.linalg.qr(sketch)
    _, _, right = np.linalg.svd(basis.T @ matrix, full_matrices=False)
    model = Model(place, weights, np.ascontiguousarray(right[:rank].T.astype(np.float32)), np.zeros((0, 0)), labels.astype(np.float64), share)
    model.vectors = model.latent(counted)
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Fit on at most ``rows`` of ``labels`` (doc_id, quality), chosen by a hash of the id."""
    sample = labelled_sample(labels, F.when(F.col("quality").isin(0, 1), F.col("quality")), rows)
    texts = one_text_each(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id"), "doc_id", "label")
    kind = T.StructType([T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.LongType()))])

    def counts(column: pa.Array) -> list:
        return list(zip(*map(shape_counts, byte_texts(column)))) or [[], []]

    # a text has at most FEATURES of them, whatever its length
    found = with_columns_by_batch(texts, "text", kind, counts, keep=["doc_id", "label"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    counted = [(np.array(r["grams"], np.int64), np.array(r["counts"], np.int64)) for r in found]
    return fit_model(counted, np.array([r["label"] for r in found], np.float64))


def scored(docs: DataFrame, model: Model, name: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with the score of each text as column ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(column: pa.Array) -> list:
        own = shared.value
        return [own.scores(own.latent([shape_counts(t) for t in byte_texts(column)]))]

    return with_columns_by_batch(docs, "text", T.StructType([T.StructField(name, T.DoubleType())]), compute, keep)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; held-out labels are not learned from."""
    model = fit(docs, labels.where(~held_out()))
    found = scored(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier takes for label 1."""
    name = fresh(docs.columns, "score")
    found = scored(docs, fit(docs, labels.where(~held_out())), name)
    return found.where(F.col(f"`{name}`") >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
