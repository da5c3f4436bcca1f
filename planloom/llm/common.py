"""Helpers of the training-data operators: reading, joins with a hot key, dense numbering."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planloom.staging import Stage

#: Keys that are split over tasks at most: the largest ones, so that no other key has over 1/1000 of the rows.
HOT_KEYS = 1000
#: Rows of a hot key for each task.
ROWS_PER_SALT = 256
#: Rows of a numbering block.
BLOCK_BITS = 12


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole_text(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def hot_salts(many: DataFrame, key: str) -> list[tuple[int, list]]:
    """(salts, keys): the largest keys of ``many``, those with as many salts (a power of two) together."""
    counts = many.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > ROWS_PER_SALT)
    found: dict[int, list] = {}
    for value, n in counts.orderBy(F.desc("_n"), key).limit(HOT_KEYS).collect():
        found.setdefault(1 << math.ceil(math.log2(n / ROWS_PER_SALT)), []).append(value)
    return sorted(found.items())


def salted_join(many: DataFrame, few: DataFrame, key: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """``many.join(few, key, how)`` with the rows of the largest keys of ``many`` spread over tasks.

    The list of hot keys has ``HOT_KEYS`` entries at most, whatever the input; it is fetched at once and becomes part of the
    expressions, so no row is joined to look its key up and nothing is broadcast. It steers the placement of rows, never the
    result. ``how`` is inner, left, left_semi or left_anti. ``many`` is read twice: pass a staged table, or one with about the
    same rows for each key as ``counted``. Keys are numbers or strings; columns other than ``key`` must not clash.
    """
    salts = F.lit(1)
    for n, keys in hot_salts(many if counted is None else counted, key):
        salts = F.when(F.col(key).isin(keys), n).otherwise(salts)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(*many.columns), salts).cast("int"))
    right = few.withColumn("_n", salts).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def numbered(df: DataFrame, order: list, stage: Stage, size: Column | None = None) -> DataFrame:
    """``df`` (narrow) with ``base``: the sum of ``size`` (1 if not given) over all rows that come earlier in ``order``.

    Range partitions are cut into blocks of 2**12 rows; block sums add up within a partition, partition sums over the
    partitions. No task sees more than one block, the block sums of one partition or one sum for each partition.
    """
    n = partitions(df.sparkSession)
    rows = stage.write(df.withColumn("_size", (F.lit(1) if size is None else size).cast("long")).repartitionByRange(n, *order)
                       .sortWithinPartitions(*order).withColumn("_pos", F.monotonically_increasing_id()))
    rows = rows.withColumn("_blk", F.shiftright("_pos", BLOCK_BITS))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    blocks = rows.groupBy("_blk").agg(F.sum("_size").alias("_bsum")).withColumn("_pid", F.shiftright("_blk", 33 - BLOCK_BITS))
    pids = blocks.groupBy("_pid").agg(F.sum("_bsum").alias("_psum"))  # one row for each partition
    pids = pids.withColumn("_pbase", earlier("_psum", before().orderBy("_pid"))).select("_pid", "_pbase")
    blocks = blocks.withColumn("_bbase", earlier("_bsum", before("_pid").orderBy("_blk"))).join(pids, "_pid").select("_blk", (F.col("_bbase") + F.col("_pbase")).alias("_bbase"))
    inside = rows.withColumn("base", earlier("_size", before("_blk").orderBy("_pos")))
    return inside.join(blocks, "_blk").withColumn("base", F.col("base") + F.col("_bbase")).drop("_size", "_pos", "_blk", "_bbase")
