"""Product codes of vectors, their codebooks fitted by member-resident Lloyd rounds.

A vector is cut into parts; each part position has a codebook of entries. The
parts live with their owner, the (position, entry, salt) that they are assigned
to: they are written in that partitioning, and stay in the files they are in as
long as their entry stays. A round

1. adds up the resident members of each owner and the owners' few sums, which
   gives the new codebooks (bounded, so they are broadcast);
2. assigns the members again where they are. Those whose entry stays are
   written in place; only the others go through a shuffle to their new owner.

The salt is a hash of the row, with at least ``SALTS`` values and about
``OWNED`` rows to each, so that an entry with a third of all rows has many
owners. The tables of the round before are removed once the next are written.
At the end the vectors are coded against the last codebooks, row by row.

All numbers are whole: floor(scale * component), squared distances, and
floor(sum / count). Distances use matrix products in double precision only
where these are exact.

Defined cases: vectors that are null or hold null or non-finite components are
left out; vectors of another length than the commonest (the longest of equally
common ones), or without components, are not fitted on and have null code and
error; a length that does not divide is filled with zeros, which changes no
distance; with fewer vectors than entries the codebook has one entry for each;
null ids come after all others among the first entries, equal ids are ordered
by their vector; components beyond 2**24 after scaling count as that; rows that
repeat are all kept; rows with a null label have their own sum; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.llm.common import pieces_of_rows
from wardloom.llm.vectors import common_length, fixed_point, matrix
from wardloom.sources.sinks import discard, new_location

SCALE, BITS = 1024, 24
PARTS, ENTRIES, ROUNDS = 4, 256, 4
SALTS, OWNED = 64, 1 << 18
BLOCK_ROWS = 4096

# codebooks: an array of shape parts x entries x width
Codebooks = np.ndarray


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry of the smallest squared distance to each row, the first of equally near ones, and that distance."""
    if not parts.shape[1]:
        return np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    largest = max(int(np.abs(parts).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * largest * largest * parts.shape[1] < 1 << 53:
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        distance = ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    else:
        distance = np.stack([((parts - e) ** 2).sum(axis=1) for e in entries], axis=1)
    chosen = distance.argmin(axis=1)
    return chosen, distance[np.arange(len(parts)), chosen]


def split(x: np.ndarray, parts: int) -> np.ndarray:
    """rows x parts x width, filled with zeros to equal parts."""
    width = -(-x.shape[1] // parts)
    out = np.zeros((len(x), parts * width), np.int64)
    out[:, : x.shape[1]] = x
    return out.reshape(len(x), parts, width)


def first_codebooks(rows: DataFrame, d: int, parts: int, entries: int) -> Codebooks:
    """The parts of the vectors with the smallest ids; at most ``entries`` rows reach the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()
    return split(np.array([r["x"] for r in first], np.int64).reshape(len(first), d), parts).transpose(1, 0, 2)


_MEMBER = T.StructType([
    T.StructField("position", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("salt", T.IntegerType()),
    T.StructField("part", T.ArrayType(T.LongType())), T.StructField("moved", T.BooleanType()),
])


def _members(position: np.ndarray, entry: np.ndarray, salt: np.ndarray, part: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
    return pa.RecordBatch.from_arrays([
        pa.array(position, pa.int32()), pa.array(entry, pa.int32()), pa.array(salt, pa.int32()),
        pa.ListArray.from_arrays(offsets, pa.array(part.ravel(), pa.int64())), pa.array(moved),
    ], names=_MEMBER.names)


def _settle(members: DataFrame, location: str) -> list[str]:
    """Write members: those that stay where they are, those that moved with their new owner. Returns both folders."""
    spark = members.sparkSession
    members.write.partitionBy("moved").parquet(f"{location}/all")
    written = spark.read.schema(_MEMBER).parquet(f"{location}/all")
    movers = written.where("moved").drop("moved").repartition("position", "entry", "salt")
    movers.write.parquet(f"{location}/moved")
    return [f"{location}/all", f"{location}/moved"]


def _resident(spark, folders: list[str]) -> DataFrame:
    stay, came = folders
    columns = [f.name for f in _MEMBER if f.name != "moved"]
    kept = spark.read.schema(_MEMBER).parquet(stay).where("not moved").select(*columns)
    return kept.unionByName(spark.read.schema(T.StructType([f for f in _MEMBER if f.name != "moved"])).parquet(came))


def _place(rows: DataFrame, d: int, books: Codebooks, salts: int) -> DataFrame:
    """Each part of each row with its first owner; all of them move there."""
    parts, width = books.shape[0], books.shape[2]
    sent = rows.sparkSession.sparkContext.broadcast(books)
    salted = rows.select("x", F.pmod(F.xxhash64("vec_id", "x", F.monotonically_increasing_id()), F.lit(salts)).cast("int").alias("salt"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of_rows(batch, BLOCK_ROWS):
                own = split(matrix(piece.column(0), d), parts)
                salt = piece.column(1).to_numpy()
                for p in range(parts):
                    entry, _ = nearest(own[:, p], sent.value[p])
                    yield _members(np.full(len(own), p), entry, salt, own[:, p].reshape(len(own), width), np.ones(len(own), bool))

    return salted.mapInArrow(run, _MEMBER)


def _reassign(resident: DataFrame, books: Codebooks) -> DataFrame:
    sent, width = resident.sparkSession.sparkContext.broadcast(books), books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of_rows(batch, BLOCK_ROWS):
                position, before, salt = (piece.column(i).to_numpy() for i in range(3))
                part = matrix(piece.column(3), width)
                entry = np.empty(len(part), np.int64)
                for p in np.unique(position).tolist():
                    own = position == p
                    entry[own], _ = nearest(part[own], sent.value[p])
                yield _members(position, entry, salt, part, entry != before)

    return resident.mapInArrow(run, _MEMBER)


def _updated(resident: DataFrame, books: Codebooks) -> Codebooks:
    """floor(sum / count) of the members of each entry; an entry without members stays."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            position, entry = (batch.column(i).to_numpy().astype(np.int64) for i in range(2))
            part = matrix(batch.column(2), width)
            for key in np.unique(position << 32 | entry).tolist():
                own = part[(position << 32 | entry) == key]
                held = sums.setdefault((key >> 32, key & 0xFFFFFFFF), [0, [0] * width])
                held[0] += len(own)
                # whole numbers of any size: a task's total may be beyond a long
                held[1] = [a + b for a, b in zip(held[1], own.sum(axis=0).tolist())]
        for (p, e), (n, total) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([p] * width, pa.int32()), pa.array([e] * width, pa.int32()), pa.array(range(width), pa.int32()),
                pa.array([n] * width, pa.int64()), pa.array(list(map(str, total)), pa.string()),
            ], names=["position", "entry", "place", "n", "total"])

    parts = resident.select("position", "entry", "part").mapInArrow(run, "position int, entry int, place int, n long, total string")
    sums = parts.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    out = books.copy()
    for r in sums.collect():  # one row for each number in the codebooks
        out[r["position"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def fit(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of Lloyd over (vec_id, x), x arrays of longs of one length."""
    spark = rows.sparkSession
    n = rows.count()
    d = common_length(rows, "x")
    books = first_codebooks(rows, d, parts, entries)
    if not n or not d or not rounds:
        return books
    salts = max(SALTS, -(-n // OWNED))
    folders = _settle(_place(rows, d, books, salts), new_location(spark, "members"))
    for step in range(rounds):
        resident = _resident(spark, folders)
        following = _updated(resident, books)
        if (following == books).all():
            break  # no later round changes anything
        books = following
        if step + 1 < rounds:
            moved_on = _settle(_reassign(resident, books), new_location(spark, "members"))
            for folder in folders:
                discard(spark, folder)
            folders = moved_on
    for folder in folders:
        discard(spark, folder)
    return books


def digest(books: Codebooks) -> str:
    """SHA-256 of all numbers, by part, entry and position within the part."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(rows: DataFrame, books: Codebooks, d: int, x: str = "x") -> DataFrame:
    """``rows`` with ``code`` (two hex digits for each part) and ``error`` in place of the vector ``x``."""
    keep = [c for c in rows.columns if c != x]
    sent = rows.sparkSession.sparkContext.broadcast(books)
    parts, ready = books.shape[0], bool(d and books.shape[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces_of_rows(batch, BLOCK_ROWS):
                column = piece.column(len(keep))
                fits = (np.asarray(column.value_lengths()) == d) & ready
                codes, errors = np.full(len(fits), None, object), np.full(len(fits), None, object)
                if fits.any():
                    own = split(matrix(column.filter(pa.array(fits)), d), parts)
                    found = [nearest(own[:, p], sent.value[p]) for p in range(parts)]
                    codes[fits] = ["".join(f"{e:02x}" for e in row) for row in zip(*(f[0].tolist() for f in found))]
                    errors[fits] = [sum(row) for row in zip(*(f[1].tolist() for f in found))]
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[: len(keep)], pa.array(codes.tolist(), pa.string()), pa.array(errors.tolist(), pa.int64())],
                    names=[*keep, "code", "error"],
                )

    source = rows.select(*keep, x)
    schema = T.StructType([*source.select(*keep).schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return source.mapInArrow(run, schema)


def with_label_error(found: DataFrame) -> DataFrame:
    """Add the error summed over the rows of equal label; added up before the shuffle, joined back by label."""
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")


def report(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every clean row of (vec_id, embedding, label)."""
    clean = rows.select("vec_id", fixed_point(F.col("embedding"), SCALE, 0, BITS).alias("x"), "label").where("x is not null")
    d = common_length(clean, "x")
    books = fit(clean.where(F.size("x") == d).select("vec_id", "x"))
    found = with_label_error(coded(clean, books, d))
    return found.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
