"""Write result tables, and find the shared folder to write them in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting writes below its warehouse.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the whole cluster")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/scratch"


def new_location(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/wardloom/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage at a point that survives lost executors, and lets later
    readers prune columns and push filters.
    """
    location = new_location(df.sparkSession, name)
    df.write.option("compression", codec).parquet(location)
    return df.sparkSession.read.schema(df.schema).parquet(location)


def discard(spark: SparkSession, location: str) -> None:
    """Remove a scratch table that nothing reads any more; only below the library's own folder."""
    if not location.startswith(f"{shared_folder(spark)}/wardloom/"):
        raise ValueError(f"not a scratch table: {location}")
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def write_table(df: DataFrame, path: str, fmt: str = "csv", single_file: bool = False) -> str:
    """Write a result table with a header; small report tables may ask for one file."""
    writer = (df.coalesce(1) if single_file else df).write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt must be 'csv' or 'parquet', not {fmt!r}")
    return path


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every floating-point column, for display or comparison."""
    floats = {
        f.name: F.round(f.name, digits)
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df
