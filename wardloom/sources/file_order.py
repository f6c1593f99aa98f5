"""Number the rows of a scan as its files have them, without sorting the data.

Files count in the order of their paths, rows as they stand in their file. The
number of a row is its place in its file (or, for text formats, in its split of
the file) plus the rows of all files and splits before. Only one count for each
file or split, as few as the scan has tasks, passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardloom.sources.schemas import ROW_LABEL

_WHERE = ("_file", "_block")


def with_file_order(scan: DataFrame, name: str = ROW_LABEL) -> DataFrame:
    """Add the 0-based number of each row; ``scan`` is a plain read of files, possibly with columns chosen.

    An empty scan gives an empty result.
    """
    if "row_index" in scan.select("_metadata").schema["_metadata"].dataType.names:
        place, block = F.col("_metadata.row_index"), F.lit(0).cast("long")
    else:
        # a text split is read from its start by one task, so its rows are numbered in a row
        place, block = F.monotonically_increasing_id(), F.col("_metadata.file_block_start")
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_file"), block.alias("_block"), place.alias("_place"))
    splits = tagged.groupBy(*_WHERE).agg(F.count(F.lit(1)).alias("n"), F.min("_place").alias("first")).collect()
    before, rows = 0, []
    for r in sorted(splits, key=lambda r: (r["_file"], r["_block"])):
        rows.append((r["_file"], r["_block"], before - r["first"]))
        before += r["n"]
    shifts = scan.sparkSession.createDataFrame(rows, "_file string, _block long, _shift long")
    return tagged.join(F.broadcast(shifts), list(_WHERE)).select(*scan.columns, (F.col("_place") + F.col("_shift")).alias(name))
