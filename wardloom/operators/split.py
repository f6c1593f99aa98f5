"""Reproducible stratified split without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardloom.functions.lookups import SEED
from wardloom.operators import skew

HELD_OUT = 0.3
TEST_OF_HELD_OUT = 0.5
PREFIX = 4
# Strata whose cut points are sent along with the tasks; beyond, a plain join.
BROADCAST_STRATA = 10_000


def row_hash(key: Column, seed: int = SEED) -> Column:
    """Portable random-looking rank of a key: the same in every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _share_up(count: Column, share: float) -> Column:
    """ceil(count * share), exact for shares given to six decimals."""
    millionths = round(share * 1_000_000)
    return F.floor((count.cast("decimal(20,0)") * millionths + 999_999) / 1_000_000).cast("long")


def split_cuts(df: DataFrame, label: str, key: str, seed: int = SEED,
               held_out: float = HELD_OUT, test_share: float = TEST_OF_HELD_OUT) -> DataFrame:
    """Per stratum, the hash of the last test row and the last held-out row.

    Rows are counted by stratum and hash prefix; only the two prefixes in
    which a cut falls are then ranked row by row.
    """
    hashed = df.select(F.col(label).alias("_stratum"), row_hash(F.col(key), seed).alias("_hash"))
    hashed = hashed.withColumn("_prefix", F.substring("_hash", 1, PREFIX))
    everything = Window.partitionBy("_stratum")
    running = everything.orderBy("_prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    prefixes = (
        hashed.groupBy("_stratum", "_prefix")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_upto": F.sum("_n").over(running), "_total": F.sum("_n").over(everything)})
        .withColumn("_held", _share_up(F.col("_total"), held_out))
        .withColumn("_test", _share_up(F.col("_held"), test_share))
    )
    wanted = (
        prefixes.select("*", F.explode(F.array("_test", "_held")).alias("_rank"))
        .where((F.col("_rank") > F.col("_upto") - F.col("_n")) & (F.col("_rank") <= F.col("_upto")))
        .groupBy("_stratum", "_prefix")
        .agg(
            F.max(F.when(F.col("_rank") == F.col("_test"), F.col("_rank") - F.col("_upto") + F.col("_n")))
            .alias("_test_row"),
            F.max(F.when(F.col("_rank") == F.col("_held"), F.col("_rank") - F.col("_upto") + F.col("_n")))
            .alias("_held_row"),
        )
    )
    wanted = wanted.select(F.col("_stratum").alias("_s"), F.col("_prefix").alias("_p"), "_test_row", "_held_row")
    same = F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_prefix") == F.col("_p"))
    place = F.row_number().over(Window.partitionBy("_stratum", "_prefix").orderBy("_hash"))
    return (
        _small_join(hashed, wanted, same, "inner")
        .withColumn("_row", place)
        .groupBy("_stratum")
        .agg(
            F.max(F.when(F.col("_row") == F.col("_test_row"), F.col("_hash"))).alias("_test_cut"),
            F.max(F.when(F.col("_row") == F.col("_held_row"), F.col("_hash"))).alias("_held_cut"),
        )
    )


def _small_join(big: DataFrame, small: DataFrame, on: Column, how: str) -> DataFrame:
    """Join a per-stratum table: sent to every task if counted small enough.

    The table is fetched at most once, up to the limit, and becomes a local
    relation; with more strata than that an ordinary join takes over.
    """
    rows = small.limit(2 * BROADCAST_STRATA + 1).collect()
    if len(rows) > 2 * BROADCAST_STRATA:
        return big.join(small, on, how)
    local = big.sparkSession.createDataFrame(rows, small.schema)
    return big.join(F.broadcast(local), on, how)


def stratified_split(df: DataFrame, label: str = "hospital_expire_flag", key: str = "hadm_id",
                     seed: int = SEED, held_out: float = HELD_OUT,
                     test_share: float = TEST_OF_HELD_OUT) -> DataFrame:
    """Add ``split``: ``train``, ``val`` or ``test``, by hash rank per stratum.

    Per stratum of n rows, ceil(held_out * n) are held out, and of these
    ceil(test_share * held) form the test split.
    """
    cuts = split_cuts(df, label, key, seed, held_out, test_share).withColumnRenamed("_stratum", "_s")
    hashed = df.withColumn("_hash", row_hash(F.col(key), seed))
    split = (
        F.when(F.col("_hash") <= F.col("_test_cut"), F.lit("test"))
        .when(F.col("_hash") <= F.col("_held_cut"), F.lit("val"))
        .otherwise(F.lit("train"))
    )
    return (
        _small_join(hashed, cuts, F.col(label).eqNullSafe(F.col("_s")), "left")
        .withColumn("split", split)
        .select(*df.columns, "split")
    )


def grouped_split(df: DataFrame, label: str, key: str, group_key: str, seed: int = SEED,
                  held_out: float = HELD_OUT, test_share: float = TEST_OF_HELD_OUT,
                  min_rows: int = skew.HEAVY_ROWS) -> DataFrame:
    """Split whole groups (say, patients) so none is on both sides.

    A group's stratum is its largest label; rows without a group are trained
    on. Groups holding a large share of the rows get their split by broadcast,
    all others by an ordinary join.
    """
    groups = df.where(F.col(group_key).isNotNull()).groupBy(group_key).agg(F.max(label).alias(label))
    placed = stratified_split(groups, label, group_key, seed, held_out, test_share).select(group_key, "split")
    heavy = skew.heavy_keys(df, group_key, min_rows)
    if heavy:
        is_heavy = F.coalesce(F.col(group_key).isin(heavy), F.lit(False))
        joined = df.where(~is_heavy).join(placed, group_key, "left").unionByName(
            df.where(is_heavy).join(F.broadcast(placed.where(is_heavy)), group_key, "left")
        )
    else:
        joined = df.join(placed, group_key, "left")
    return joined.select(*df.columns, F.coalesce("split", F.lit("train")).alias("split"))
