"""Joins whose many-side may hold a hot key.

A hot key is one that holds at least ``HOT_SHARE`` of the rows, so there are at most ``1 / HOT_SHARE`` of them
whatever the size of the table. They are found on a sample, fixed once as literal rows, and only steer the
placement of rows: a wrong guess costs time, never a result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 1000
SAMPLE = 0.01
ROWS_PER_TASK = 200_000
SMALL_BYTES = 256 * 1024 * 1024
#: Written bytes that a loop may broadcast in a round; they may be ten times as many in memory.
BROADCAST_BYTES = 256 * 1024


def plan_bytes(df: DataFrame) -> int:
    """Size the optimizer expects for ``df`` (exact for tables written by ``staging``)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_small(df: DataFrame, limit: int | None = None) -> bool:
    return plan_bytes(df) <= (SMALL_BYTES if limit is None else limit)


def widen(df: DataFrame, limit: int = 32 * 1024 * 1024) -> DataFrame:
    """Spreads a small table, which often is one file split, over all cores before a join expands it."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if is_small(df, limit) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that broadcasts neither side, whatever sizes the optimizer expects.

    It expects as much as the read columns of a file have bytes, which says little about rows that are computed from them and
    exploded: keys in order take next to nothing in a file, so a broadcast of their cells can be a thousand times as large.
    """
    return df if df.isStreaming else df.hint("merge")


def hot_keys(df: DataFrame, keys: list[str], sample: float = SAMPLE, rows_per_task: int = ROWS_PER_TASK,
             small_bytes: int | None = None) -> list[tuple]:
    """Key values that need several tasks, with the number of tasks: ``[(key values..., salts)]``."""
    if df.isStreaming or is_small(df, small_bytes):
        return []
    counts = df.select(*keys).sample(sample, seed=7).groupBy(*keys).count()
    floor_rows = max(1, int(rows_per_task * sample))
    top = counts.where(F.col("count") >= floor_rows).orderBy(F.desc("count")).limit(int(1 / HOT_SHARE)).collect()
    return [tuple(r[k] for k in keys) + (math.ceil(r["count"] / (rows_per_task * sample)),) for r in top]


def _salts(keys: list[str], hot: list[tuple]) -> Column:
    """Number of salts of a row: looked up in the (at most 1000 entry) literal table of hot keys."""
    table = F.create_map(*[F.lit(v) for row in hot for v in ("\x1f".join(str(k) for k in row[:-1]), row[-1])])
    return F.coalesce(table[F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys])], F.lit(1))


def salted_join(many: DataFrame, few: DataFrame, keys: list[str], condition: Column | None = None,
                how: str = "inner", hot: list[tuple] | None = None, shuffle: bool = False) -> DataFrame:
    """``many.join(few, keys, how)`` with the rows of hot keys in ``many`` spread over several tasks.

    Each row of ``many`` gets one salt and each row of ``few`` with a hot key is repeated per salt, so any join
    type that keeps the left side (inner, left, left_semi, left_anti) stays exact. ``condition`` may use columns
    of both sides; column names other than ``keys`` must not overlap. With ``shuffle`` neither side is broadcast.
    """
    if hot is None:
        hot = hot_keys(many, keys)
    on = list(keys)
    if hot:
        rest = [f for f in many.schema if f.name not in keys]
        n = _salts(keys, hot)
        # a hash of the row, so that a task that runs again gives every row the same salt; maps hash as text
        spread = F.xxhash64(*[F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in rest] or keys)
        many = many.withColumn("_salt", F.pmod(spread, n.cast("long")).cast("int"))
        few = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
        on.append("_salt")
    side = shuffled if shuffle and not many.isStreaming else lambda df: df
    if condition is None:
        out = many.join(side(few), on, how)
    else:
        renamed = few.select(*[F.col(k).alias(f"_r_{k}") for k in on], *[c for c in few.columns if c not in on])
        match = condition
        for k in on:
            match = match & (F.col(k) == F.col(f"_r_{k}"))
        out = many.join(side(renamed), match, how).drop(*[f"_r_{k}" for k in on])
    return out.drop("_salt")


def join_all(many: DataFrame, few: DataFrame, max_rows: int = 10_000, spread: int = 64) -> DataFrame:
    """Every row of ``many`` with every row of a rule-like table ``few`` (rules that apply to everything).

    The rows of ``many`` are spread over ``spread`` keys and ``few`` is repeated per key, so the pairing is an ordinary
    hash join and no task sees all of ``many``. ``few`` is broadcast when its checked size is at most ``max_rows``.
    """
    small = few.limit(max_rows + 1).count() <= max_rows
    n = 8 if small else spread
    hashable = [f.name for f in many.schema if "map<" not in f.dataType.simpleString()] or [F.lit(0)]
    left = many.withColumn("_j", F.pmod(F.xxhash64(*hashable), F.lit(n)))
    right = few.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    return left.join(F.broadcast(right) if small else right, "_j").drop("_j")
