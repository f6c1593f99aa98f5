"""Whitening of integer vectors by shifted Cholesky QR.

The distinct vectors are centred exactly, as n * x - S, and seen as the rows of
a tall matrix A. A pass adds up the Gram matrix of A after the triangular
solves with all factors found so far; its Cholesky factor is the next one. The
first Gram matrix is shifted by a multiple of the rounding error, so that it
has a factor however close to singular it is, and so is any later one that has
none. Passes go on until the rows are orthonormal. The product of the factors
is R of A = QR, and its singular values and right vectors are those of A: the
eigenvectors of the covariance without ever squaring its condition number.

A pass is narrow: every task sends one triangle of numbers, added up by place.
Only matrices of dimension x dimension reach the driver. The distinct vectors
are written once and read by each pass.

Defined cases: vectors that are null or hold null or non-finite entries are
left out; vectors of another length than the commonest (the longest of equally
common ones) are not fitted on, and their ``deviation`` and ``whitened`` are
null, one row for each component; a component without variance (to rounding)
has ``whitened`` null; a deviation beyond a long is null; entries beyond 2**40
after scaling count as that; rows that repeat an id or a vector are all kept;
null ids are kept; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.vectors import common_length, fixed_point, matrix
from wardloom.sources.sinks import materialized

SCALE, OFFSET, BITS = 64, 1_000_000, 40
COMPONENTS = 16
PASSES = 8
ORTHONORMAL = 1e-13
# Singular values below this share of the largest are rounding.
RANK = 1e-12
_LONG = 1 << 63


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = SCALE, offset: int = OFFSET, name: str = "x") -> DataFrame:
    """``rows`` whose vector is clean, with its fixed-point form as array of longs ``name``."""
    return rows.withColumn(name, fixed_point(F.col(vector), scale, offset, BITS)).where(F.col(name).isNotNull())


@dataclass
class Whitening:
    n: int
    sums: list[int]
    wide: bool  # whether products of entries are beyond a long
    components: np.ndarray  # a row each, by falling eigenvalue
    eigenvalues: np.ndarray  # 0 for a component without variance
    trace: float
    identity_error: float = 0.0

    @property
    def explained(self) -> list[float]:
        return [float(e / self.trace) if self.trace > 0 else 0.0 for e in self.eigenvalues]

    def near(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and S less the whole part of the mean (S less n times it), exact."""
        kind = object if self.wide else np.int64
        means = [s // self.n for s in self.sums]
        rest = np.array([s - self.n * m for s, m in zip(self.sums, means)], kind)
        return x.astype(kind) - np.array(means, kind), rest

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n as doubles, from the exact n * x - S."""
        own, rest = self.near(x)
        return ((own * self.n - rest) / self.n).astype(np.float64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A column for each component; nan where it has no variance."""
        deviations = np.where(self.eigenvalues > 0, np.sqrt(self.eigenvalues), np.nan)
        return self.rows(x) @ self.components.T / deviations

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S) ** 2 of each row, its parts added up as longs and put together as whole numbers of any size."""
        own, rest = self.near(x)
        n, constant = self.n, sum(int(r) ** 2 for r in rest)
        squares, products = (own * own).sum(axis=1).tolist(), (own * rest).sum(axis=1).tolist()
        found = [n * n * q - 2 * n * p + constant for q, p in zip(squares, products)]
        return [v if v < _LONG else None for v in found]


def solved(rows: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """rows times the inverse of an upper triangular factor, by substitution."""
    out = np.empty_like(rows)
    for j in range(factor.shape[0]):
        out[:, j] = (rows[:, j] - out[:, :j] @ factor[:j, j]) / factor[j, j]
    return out


def _moments(fitted: DataFrame, width: int, d: int, of: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Gram matrix and column sums of the ``d`` columns that ``of`` makes of the rows, each task's added up first."""
    places = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            rows = of(matrix(batch.column(0), width))
            gram += rows.T @ rows
            total += rows.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram[places], total])], pa.list_(pa.float64()))], names=["part"])

    parts = fitted.mapInArrow(run, "part array<double>")
    sums = parts.select(F.posexplode("part").alias("place", "value")).groupBy("place").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros(len(places[0]) + d)
    for r in sums:
        flat[r["place"]] = r["value"]
    gram = np.zeros((d, d))
    gram[places] = flat[: len(places[0])]
    return np.triu(gram) + np.triu(gram, 1).T, flat[len(places[0]) :]


def _exact_sums(fitted: DataFrame, d: int) -> tuple[int, list[int], int]:
    """Rows, sum of each dimension and the largest range of one, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(0), d)
            if len(rows) and d:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(d), pa.int32()), pa.array(np.full(d, len(rows)), pa.int64()),
                    *(pa.array(v, pa.int64()) for v in (rows.sum(axis=0), rows.min(axis=0), rows.max(axis=0))),
                ], names=["place", "n", "total", "low", "high"])

    parts = fitted.mapInArrow(run, "place int, n long, total long, low long, high long")
    sums = parts.groupBy("place").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), (F.max("high") - F.min("low")).alias("spread")
    ).collect()
    totals = {r["place"]: int(r["total"]) for r in sums}
    return (sums[0]["n"] if sums else 0), [totals[i] for i in range(d)] if sums else [], max((r["spread"] for r in sums), default=0)


def _factor(gram: np.ndarray, shift: float) -> np.ndarray:
    """Upper Cholesky factor of a Gram matrix, shifted as far as it takes."""
    step = shift
    while True:
        try:
            return np.linalg.cholesky(gram + step * np.eye(len(gram))).T
        except np.linalg.LinAlgError:
            step = max(step * 10, np.finfo(float).eps * np.trace(gram))


def _root(gram: np.ndarray) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    return (vectors * np.sqrt(np.maximum(values, 0))) @ vectors.T


def fit(rows: DataFrame, x: str = "x", components: int = COMPONENTS) -> Whitening:
    """Principal axes of the distinct vectors in ``x`` (arrays of longs), each counted once."""
    d = common_length(rows, x)
    fitted = materialized(rows.where(F.size(x) == d).select(F.col(x).alias("x")).distinct(), "distinct-vectors")
    n, sums, spread = _exact_sums(fitted, d)
    kept = min(components, d)
    wide = 2 * d * (spread + 1) * max(spread + 1, n) >= _LONG
    found = Whitening(n, sums, wide, np.zeros((kept, d)), np.zeros(kept), 0.0)
    if not n or not d:
        return found
    factors: list[np.ndarray] = []

    def orthogonal(x: np.ndarray) -> np.ndarray:
        out = found.rows(x)
        for factor in factors:
            out = solved(out, factor)
        return out

    upper = np.eye(d)
    for step in range(PASSES):
        gram, _ = _moments(fitted, d, d, orthogonal)
        if not step:
            found.trace = float(np.trace(gram)) / n
            if found.trace == 0:
                return found
        # what is orthonormal already, or has no rank, needs no further pass
        values = np.linalg.eigvalsh(gram)
        if step and (np.minimum(np.abs(values - 1), np.abs(values)) <= ORTHONORMAL * d).all():
            break
        shift = 0.0 if step else 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
        factors.append(_factor(gram, shift))
        upper = factors[-1] @ upper
    # the last Gram matrix is the identity but for rounding and columns without rank
    _, singular, right = np.linalg.svd(_root(gram) @ upper)
    singular = np.where(singular > RANK * singular[0], singular, 0.0)
    found.components, found.eigenvalues = right[:kept], (singular**2 / n)[:kept]
    real = np.flatnonzero(found.eigenvalues > 0)
    gram, total = _moments(fitted, d, len(real), lambda x: found.whiten(x)[:, real])
    found.identity_error = float(np.abs(gram / n - np.outer(total, total) / n**2 - np.eye(len(real))).max(initial=0))
    return found


def whitened(rows: DataFrame, model: Whitening, x: str = "x", keep: tuple[str, ...] = ("vec_id",)) -> DataFrame:
    """A row for each row and component: ``keep``, component, n, deviation, whitened, explained, identity_error."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d, kept = len(model.sums), len(model.eigenvalues)
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(len(names))
            lengths = np.asarray(column.value_lengths())
            fits = lengths == d
            deviations = np.full(batch.num_rows, None, object)
            values = np.full((batch.num_rows, kept), np.nan)
            if fits.any():
                inside = matrix(column.filter(pa.array(fits)), d)
                deviations[fits] = own.deviations(inside)
                values[fits] = own.whiten(inside)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * kept)
            flat = pa.array(values.ravel(), from_pandas=True)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(deviations.tolist(), pa.int64()), pa.ListArray.from_arrays(offsets, flat)],
                names=[*names, "_deviation", "_whitened"],
            )

    source = rows.select(*names, F.col(x))
    schema = source.select(*names).schema.add("_deviation", T.LongType()).add("_whitened", T.ArrayType(T.DoubleType()))
    shares = F.array(*[F.lit(e) for e in model.explained]) if kept else F.array().cast("array<double>")
    return source.mapInArrow(run, schema).select(*names, "_deviation", F.posexplode("_whitened").alias("_place", "whitened")).select(
        *names, (F.col("_place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
        "whitened", F.element_at(shares, F.col("_place") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def report(rows: DataFrame) -> DataFrame:
    """Whitened components of every clean row of (vec_id, embedding)."""
    clean = integer_vectors(rows.select("vec_id", "embedding")).select("vec_id", "x")
    return whitened(clean, fit(clean))
