"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Texts are handed to the batch functions in pieces of about this many
# characters, so that a task's memory does not follow the batch size.
PIECE_CHARS = 4_000_000

Column = Sequence | pa.Array

NO_ID = -(1 << 63)


def one_text_each(texts: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and one ``text`` of each: of several the one with the least hash, chosen in each task before the shuffle."""
    return texts.groupBy(*keys).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """``name``, with underscores in front until no column has it (in any case)."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = "_" + name
    return name


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about ``limit`` bytes of text; a row stays whole."""
    start = size = 0
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    for i, n in enumerate(lengths):
        size += n or 0
        if size >= limit:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def pieces_of_rows(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of at most ``rows`` rows."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def with_columns_by_batch(
    df: DataFrame,
    text: str,
    added: T.StructType,
    compute: Callable[[pa.Array], Sequence[Column]],
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Add columns that a Python function derives from one text column.

    ``compute`` gets an Arrow array of texts and returns one column per field
    of ``added``. Rows pass through one by one, so their order, repeats and
    other columns stay; the text is carried along only if it is in ``keep``
    (default: all columns).
    """
    keep = list(df.columns if keep is None else keep)
    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    names = [f.name for f in added.fields]
    source = df.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, text):
                new = [pa.array(c, k) for c, k in zip(compute(piece.column(text)), kinds)]
                yield pa.RecordBatch.from_arrays([piece.column(c) for c in keep] + new, names=[*keep, *names])

    schema = T.StructType([df.schema[c] for c in keep] + added.fields)
    return source.mapInArrow(run, schema)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps, which it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def document_keys(docs: DataFrame) -> DataFrame:
    """doc, part and text of each row, equal in doc and part only for rows of equal id and text; null texts are empty.

    ``doc`` is the id. ``part`` is 0 where the id has one text, else a hash of
    the text; of a null id it is below 0 and ``doc`` the least number, so null ids
    come first in order of both.
    """
    taken = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.xxhash64("text")
    kinds = taken.where("id is not null").groupBy("id").agg(F.min(digest).alias("a"), F.max(digest).alias("b"))
    several = kinds.where("a <> b").select("id", F.lit(True).alias("several"))
    part = F.when(F.col("id").isNull(), digest.bitwiseOR(F.lit(NO_ID)))
    if not several.isEmpty():
        taken = taken.join(several, "id", "left")
        part = part.when(F.col("several"), digest.bitwiseAND(F.lit((1 << 63) - 1)))
    return taken.select(F.coalesce("id", F.lit(NO_ID)).alias("doc"), part.otherwise(F.lit(0).cast("long")).alias("part"), "text")


def id_of_keys() -> SparkColumn:
    """The id of a row of ``document_keys``."""
    return F.when((F.col("doc") != NO_ID) | (F.col("part") >= 0), F.col("doc"))
