"""Read the three clinical tables from CSV or Parquet."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardloom.functions.lookups import na_tokens
from wardloom.functions.times import parsed_time
from wardloom.sources.file_order import with_file_order
from wardloom.sources.schemas import ROW_LABEL, SCHEMAS, TABLE_FILES
from wardloom.sources.sinks import materialized


class ClinicalTables(NamedTuple):
    patients: DataFrame
    admissions: DataFrame
    diagnoses: DataFrame


def na_to_null(text: Column) -> Column:
    return F.when(text.isin(na_tokens()), None).otherwise(text)


def _typed(text: Column, kind: T.DataType, strict: bool) -> Column:
    value = na_to_null(text)
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.IntegralType):
        # whole numbers of a column that also had gaps are written as 65.0
        value = F.regexp_replace(F.trim(value), r"\.0+$", "")
    if isinstance(kind, T.TimestampNTZType):
        return parsed_time(value, strict)
    return value.cast(kind) if strict else value.try_cast(kind)


def _raw_csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True,
                   multi_line: bool = False) -> DataFrame:
    """CSV with a header and a leading row-label column.

    The file's own header decides the column order, so extra columns are
    allowed; only the declared ones (and the label, as ``_row_id``) are kept,
    and only they are parsed. Text that is not of the declared type raises
    unless ``strict`` is off, in which case it becomes null. ``multi_line``
    accepts quoted line breaks; a file is then read in one piece.
    """
    raw = _raw_csv(spark, path, multi_line)
    label, *names = raw.columns
    columns = [F.col(f"`{label}`").try_cast("long").alias(ROW_LABEL)]
    for field in schema:
        if field.name in names:
            columns.append(_typed(F.col(field.name), field.dataType, strict).alias(field.name))
    return raw.select(columns)


class Parsed(NamedTuple):
    rows: DataFrame
    rejects: DataFrame  # file, row_label, column_name, text: a row for each cell that could not be parsed


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> Parsed:
    """As :func:`read_csv_table`, bad cells null, and beside the rows a table of these cells.

    The files are parsed once: typed rows and their rejects are written
    together, and each of the two tables reads its own columns of that.
    """
    raw = _raw_csv(spark, path, multi_line)
    label, *names = raw.columns
    known = [f for f in schema if f.name in names]
    typed = {f.name: _typed(F.col(f.name), f.dataType, False) for f in known}
    bad = [
        F.when(na_to_null(F.col(f.name)).isNotNull() & typed[f.name].isNull(), F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("text")))
        for f in known if not isinstance(f.dataType, T.StringType)
    ]
    bad.append(F.when(F.col(f"`{label}`").isNotNull() & F.col(f"`{label}`").try_cast("long").isNull(),
                      F.struct(F.lit(ROW_LABEL).alias("column_name"), F.col(f"`{label}`").alias("text"))))
    parsed = materialized(raw.select(
        F.col(f"`{label}`").try_cast("long").alias(ROW_LABEL), *[c.alias(n) for n, c in typed.items()],
        F.filter(F.array(*bad), lambda x: x.isNotNull()).alias("_bad"), F.col("_metadata.file_path").alias("_file"),
    ), "parsed")
    rejects = parsed.where(F.size("_bad") > 0).select(F.col("_file").alias("file"), F.col(ROW_LABEL).alias("row_label"), F.inline("_bad"))
    return Parsed(parsed.drop("_bad", "_file"), rejects)


def read_parquet_table(spark: SparkSession, path: str, schema: T.StructType, file_order: bool = False) -> DataFrame:
    """Declared columns of a Parquet table; ``file_order`` numbers rows that have no label as the files have them."""
    raw = spark.read.parquet(path)
    if file_order and ROW_LABEL not in raw.columns:
        raw = with_file_order(raw)
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in raw.columns]
    if ROW_LABEL in raw.columns:
        columns.insert(0, F.col(ROW_LABEL).cast("long").alias(ROW_LABEL))
    return raw.select(columns)


def load_tables(spark: SparkSession, path: str, fmt: str = "csv", strict: bool = True,
                multi_line: bool = False, file_order: bool = False) -> ClinicalTables:
    """Patients, admissions and diagnoses found in one folder.

    ``file_order`` gives the rows of Parquet tables without row labels their
    place in the files as one, so that lists and groups come in that order.
    """
    frames = []
    for table, stem in TABLE_FILES.items():
        location = f"{path.rstrip('/')}/{stem}.{fmt}"
        if fmt == "csv":
            frames.append(read_csv_table(spark, location, SCHEMAS[table], strict, multi_line))
        elif fmt == "parquet":
            frames.append(read_parquet_table(spark, location, SCHEMAS[table], file_order))
        else:
            raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return ClinicalTables(*frames)


def table_sizes(tables: ClinicalTables) -> DataFrame:
    """One row per table: its name and row count."""
    counts = [
        frame.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        for name, frame in zip(tables._fields, tables)
    ]
    return counts[0].unionAll(counts[1]).unionAll(counts[2])
