"""Order-dependent columns over groups of any size.

A plain window puts a whole group into one task. For large inputs the rows are range-partitioned by
(group, order) instead, so that a hot group spans many blocks; each block is windowed on its own and the
per-block totals (one row per group and block) carry values across block borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from planloom.skew import is_small
from planloom.staging import materialize


def _blocks(df: DataFrame, group: list[str], order: list[Column], blocks: int | None) -> DataFrame:
    """Adds ``_block``; the table is written so that block borders stay fixed when tasks run again."""
    keys = [F.col(g) for g in group] + order
    ranged = df.repartitionByRange(blocks, *keys) if blocks else df.repartitionByRange(*keys)
    return materialize(ranged.withColumn("_block", F.spark_partition_id()), "blocks")


def _plain(df: DataFrame, blocks: int | None) -> bool:
    return blocks is None and is_small(df)


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: Column, name: str,
                blocks: int | None = None) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including this one."""
    if _plain(df, blocks):
        return df.withColumn(name, F.sum(value).over(
            W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    cut = _blocks(df.withColumn("_v", value), group, order, blocks)
    before = cut.groupBy(*group, "_block").agg(F.sum("_v").alias("_t")).withColumn(
        "_before", F.coalesce(F.sum("_t").over(
            W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_t")
    inner = F.sum("_v").over(W.partitionBy(*group, "_block").orderBy(*order)
                             .rowsBetween(W.unboundedPreceding, W.currentRow))
    return (cut.withColumn("_in", inner).join(before, [*group, "_block"])
            .withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before", "_v", "_block"))


def row_index(df: DataFrame, group: list[str], order: list[Column], name: str,
              blocks: int | None = None) -> DataFrame:
    """1-based position of each row in its group."""
    return running_sum(df, group, order, F.lit(1).cast("long"), name, blocks)


def previous(df: DataFrame, group: list[str], order: list[Column], values: dict[str, str],
             blocks: int | None = None) -> DataFrame:
    """``values`` maps new column names to columns whose value on the previous row of the group is wanted."""
    if _plain(df, blocks):
        w = W.partitionBy(*group).orderBy(*order)
        for new, old in values.items():
            df = df.withColumn(new, F.lag(old).over(w))
        return df
    cut = _blocks(df, group, order, blocks)
    inner = W.partitionBy(*group, "_block").orderBy(*order)
    cut = cut.withColumn("_n", F.row_number().over(inner))
    for new, old in values.items():
        cut = cut.withColumn(new, F.lag(old).over(inner))
    last = F.struct("_n", *[F.col(old).alias(f"_l{i}") for i, old in enumerate(values.values())])
    ends = cut.groupBy(*group, "_block").agg(F.max_by(last, "_n").alias("_e"))
    carry = W.partitionBy(*group).orderBy("_block")
    ends = ends.select(*group, "_block", F.lag("_e").over(carry).alias("_p"))
    out = cut.join(ends, [*group, "_block"])
    for i, new in enumerate(values):
        out = out.withColumn(new, F.when(F.col("_n") == 1, F.col("_p")[f"_l{i}"]).otherwise(F.col(new)))
    return out.drop("_n", "_p", "_block")


def running_max(df: DataFrame, group: list[str], order: list[Column], value: str, name: str,
                blocks: int | None = None) -> DataFrame:
    """Largest ``value`` on the earlier rows of the group (null on the first)."""
    if _plain(df, blocks):
        return df.withColumn(name, F.max(value).over(
            W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)))
    cut = _blocks(df, group, order, blocks)
    before = cut.groupBy(*group, "_block").agg(F.max(value).alias("_t")).withColumn(
        "_before", F.max("_t").over(
            W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1))).drop("_t")
    inner = F.max(value).over(W.partitionBy(*group, "_block").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return (cut.withColumn("_in", inner).join(before, [*group, "_block"])
            .withColumn(name, F.greatest("_in", "_before")).drop("_in", "_before", "_block"))


def middle_value(df: DataFrame, group: list[str], value: str, tie: str, name: str,
                 blocks: int | None = None) -> DataFrame:
    """Exact median of ``value`` per group as a one-row-per-group table."""
    n = df.groupBy(*group).agg(F.count(value).alias("_n"))
    ranked = row_index(df.where(F.col(value).isNotNull()), group, [F.col(value), F.col(tie)], "_i", blocks)
    lo, hi = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    return (ranked.join(n, group).where((F.col("_i") == lo) | (F.col("_i") == hi))
            .groupBy(*group).agg(F.avg(value).alias(name)))


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "rn") -> DataFrame:
    """First ``n`` rows per group. Spark keeps at most ``n`` rows per group and task before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col(name) <= n)
