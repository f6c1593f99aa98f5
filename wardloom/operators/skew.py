"""Keep one huge group from becoming one huge task."""

from __future__ import annotations

from math import isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that one task puts in order; a group of more is cut into ranges of about as many.
HEAVY_ROWS = 1_000_000
# Heavy groups that are told apart: as many only beyond 10**11 rows.
MOST_HEAVY = 100_000
TRACKED = 10_000
STEPS = 1024
FEW_SPLITS = 64
# Rows of one task where a table is small as a file and large as vectors.
TASK_ROWS = 200_000


def heavy_keys(df: DataFrame, key: str, min_rows: int = HEAVY_ROWS) -> list:
    """Values of ``key`` that hold ``min_rows`` rows or more, usually none.

    One map-side sketch over one column; small inputs cost a bare row count.
    The sketch only decides how rows are spread over tasks, never a result.
    """
    total = df.select(key).count()
    if total < min_rows:
        return []
    most = min(MOST_HEAVY, total // min_rows)
    limit = max(min_rows, total / MOST_HEAVY)
    sketch = df.where(F.col(key).isNotNull()).agg(
        F.call_function("approx_top_k", F.col(key), F.lit(int(most)), F.lit(int(max(TRACKED, 10 * most)))).alias("top")
    )
    return [entry["item"] for entry in sketch.first()["top"] if entry["count"] >= limit]


def range_cuts(df: DataFrame, value: str, rows: int = HEAVY_ROWS) -> list[float]:
    """Distinct cut points between ranges of about ``rows`` rows each: a bare count where there are none, else one job more."""
    ranges = -(-df.where(F.col(value).isNotNull()).count() // rows)
    if ranges <= 1:
        return []
    if ranges <= STEPS // 4:
        steps = [i / STEPS for i in range(1, STEPS)]
        found = df.agg(F.percentile_approx(value, steps, 10 * STEPS)).first()[0]
        cuts = [found[round(i * STEPS / ranges) - 1] for i in range(1, ranges)]
    else:
        cuts = df.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    return sorted({cut for cut in cuts if isfinite(cut)})


def group_cuts(df: DataFrame, key: str, value: str, rows: int) -> list[tuple]:
    """(key, cut points): for each group as many ranges of ``value`` as it has times ``rows`` rows; one job."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    steps = min(1 << (LEVELS - 1), max(1, -(-largest // rows)) * 4)
    shares = [i / steps for i in range(1, steps)] or [0.5]
    found = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(value, shares, 10 * steps).alias("q")).collect()
    out = []
    for r in found:
        ranges = min(-(-r["n"] // rows), steps)
        cuts = {r["q"][max(0, round(i * steps / ranges) - 1)] for i in range(1, ranges)}
        out.append((r[key], sorted(c for c in cuts if isfinite(c))))
    return out


# Cut points of one group at most: 2 ** LEVELS.
LEVELS = 14


def place_among(cuts: Column, value: Column) -> Column:
    """How many of the sorted cut points are at or below the value, by halving."""
    steps = F.array(*[F.lit(1 << i) for i in range(LEVELS, -1, -1)])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(cuts, at + step - 1) <= value, at + step).otherwise(at))


def with_range(df: DataFrame, value: str, cuts: list[float], name: str) -> DataFrame:
    """Add the 0-based range of ``value`` among ``cuts``.

    An integer on purpose: grouping by a floating-point range after a window
    over it would cost one more shuffle.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    ranged = Bucketizer(splits=edges, inputCol=value, outputCol=name, handleInvalid="keep").transform(df)
    return ranged.withColumn(name, F.col(name).cast("int"))


def numbered(
    df: DataFrame,
    key: str,
    order: list[Column | str],
    leading: Column,
    name: str,
    min_rows: int = HEAVY_ROWS,
) -> DataFrame:
    """Add the exact 1-based position of each row within its group.

    Ordinary groups are numbered in one task each. A heavy group is cut into
    ranges of ``leading`` (a number that never decreases along ``order``) of about
    ``min_rows`` rows, by its own quantiles, numbered per range, and shifted by
    the rows of the ranges before it.
    """
    heavy = heavy_keys(df, key, min_rows)
    if not heavy:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))

    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    led = df.withColumn("_leading", F.coalesce(leading.cast("double"), F.lit(float("-inf"))))
    cuts = group_cuts(led.where(F.col(key).isin(heavy)).select(key, "_leading"), key, "_leading", min_rows)
    # as many numbers as there are ranges of about min_rows rows
    table = spark.createDataFrame(cuts, f"`{key}` {kind}, _cuts array<double>")
    ranged = led.join(F.broadcast(table), key, "left").withColumn(
        "_range", F.when(F.col("_cuts").isNotNull(), place_among(F.col("_cuts"), F.col("_leading"))).otherwise(F.lit(0))
    )
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (
        ranged.where(F.col("_cuts").isNotNull())
        .groupBy(key, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(key, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    within = F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order))
    # one row for each range
    return (
        ranged.withColumn("_within", within)
        .join(F.broadcast(shifts), [key, "_range"], "left")
        .withColumn(name, F.col("_within") + F.coalesce("_shift", F.lit(0)))
        .select(*df.columns, name)
    )


def spread(scan: DataFrame, rows: int | None = None) -> DataFrame:
    """Give every core a share of a small scan before heavy work per row.

    Only a scan of fewer than ``FEW_SPLITS`` partitions, a few gigabytes at
    most, is ever moved. Meant for plain scans: on other plans the partition
    count is only known by running them.

    With ``rows``, a scan of more than so many rows a partition is cut up too,
    whatever its size: splits follow the bytes of a file, and texts that take
    few of them become wide rows. A written table is counted by its footers.
    """
    partitions = scan.rdd.getNumPartitions()
    wanted = min(scan.sparkSession.sparkContext.defaultParallelism, FEW_SPLITS)
    if rows:
        wanted = max(wanted, -(-scan.count() // rows))
    return scan.repartition(wanted) if partitions < wanted else scan
