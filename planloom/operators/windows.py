"""Runs, gaps and budgets over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.ordered import first_n, previous, running_max, running_sum


def interval_gaps(df: DataFrame, group: list[str], lo: str, hi: str, tie: str, blocks: int | None = None) -> DataFrame:
    """Positive gaps to the previous interval (by start), one row each."""
    prev = previous(df, group, [F.col(lo), F.col(hi), F.col(tie)], {"prev_hi": hi}, blocks)
    return prev.withColumn("gap", F.col(lo) - F.col("prev_hi")).where(F.col("gap") > 0)


def is_dashed(gaps: DataFrame, group: list[str], min_gap: float = 2.0, spread: float = 0.3) -> DataFrame:
    """Groups with at least two gaps >= ``min_gap`` that all stay within ``spread`` of their mean."""
    big = gaps.where(F.col("gap") >= min_gap)
    s = big.groupBy(*group).agg(F.count(F.lit(1)).alias("n_gaps"), F.avg("gap").alias("mean_gap"),
                                F.min("gap").alias("_lo"), F.max("gap").alias("_hi"))
    even = F.greatest(F.col("_hi") - F.col("mean_gap"), F.col("mean_gap") - F.col("_lo")) <= F.col("mean_gap") * spread
    return s.select(*group, "n_gaps", "mean_gap", ((F.col("n_gaps") >= 2) & even).alias("dashed"))


def runs(df: DataFrame, group: list[str], order: list[Column], new_run: Column, carry: dict[str, str], name: str = "run",
         blocks: int | None = None) -> DataFrame:
    """Numbers runs of rows: ``new_run`` (which may use the ``carry`` columns of the previous row) starts one."""
    d = previous(df, group, order, carry, blocks)
    return running_sum(d, group, order, F.when(new_run, 1).otherwise(0), name, blocks)


def merge_adjacent_texts(texts: DataFrame, group: list[str], max_dy: float = 2.0, max_gap: float = 5.0,
                         blocks: int | None = None) -> DataFrame:
    """Texts on one line with small gaps become one text (``x``, ``y``, ``width``, ``text``, ``confidence``).

    Rows are read top to bottom, left to right; a run ends when the next text is off the line or too far right.
    A run becomes one text value, so it is as long as the text line it describes.
    """
    far = (F.col("_px").isNull() | (F.abs(F.col("y") - F.col("_py")) > max_dy)
           | (F.col("x") - F.col("_px") > max_gap))
    rows = texts.withColumn("right", F.col("x") + F.col("width"))
    r = runs(rows, group, [F.round("y", 1), F.col("x"), F.col("id")], far, {"_px": "right", "_py": "y"}, "run", blocks)
    parts = F.array_sort(F.collect_list(F.struct(F.round("y", 1).alias("line"), "x", "id", "text")))
    return r.groupBy(*group, "run").agg(
        F.min("id").alias("first_id"), F.min("x").alias("x"), F.avg("y").alias("y"), F.max("right").alias("right"),
        F.min("confidence").alias("confidence"), F.count(F.lit(1)).alias("n_texts"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"))


def token_budget(df: DataFrame, group: list[str], order: list[Column], text: Column, budget: int,
                 blocks: int | None = None) -> DataFrame:
    """Longest prefix whose summed token estimate (length / 4) stays within the budget."""
    cost = F.floor(F.length(text) / 4).cast("long")
    return running_sum(df, group, order, cost, "used", blocks).where(F.col("used") <= budget)


def trim_history(messages: DataFrame, n: int) -> DataFrame:
    """The first message of each conversation and the newest ``n`` of the others."""
    first = messages.groupBy("conv_id").agg(F.min("turn").alias("turn"))
    rest = messages.join(first, ["conv_id", "turn"], "left_anti")
    newest = first_n(rest, ["conv_id"], [F.desc("turn")], n).drop("rn")
    return messages.join(first, ["conv_id", "turn"], "left_semi").unionByName(newest.select(*messages.columns))


def polyline_length(points: DataFrame, group: list[str], blocks: int | None = None) -> DataFrame:
    """Length of each polyline given as rows (seq, x, y)."""
    p = previous(points, group, [F.col("seq")], {"_px": "x", "_py": "y"}, blocks)
    return p.groupBy(*group).agg(F.coalesce(F.sum(F.hypot(F.col("x") - F.col("_px"), F.col("y") - F.col("_py"))),
                                            F.lit(0.0)).alias("length"), F.count(F.lit(1)).alias("n_points"))


def drop_collinear(points: DataFrame, group: list[str], tolerance: float, blocks: int | None = None) -> DataFrame:
    """Drops interior points closer than ``tolerance`` to the line through their two neighbours."""
    p = previous(points, group, [F.col("seq")], {"_ax": "x", "_ay": "y"}, blocks)
    p = previous(p, group, [F.desc("seq")], {"_bx": "x", "_by": "y"}, blocks)
    dx, dy = F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay")
    n = F.hypot(dx, dy)
    off = F.when(n > 0, F.abs((F.col("y") - F.col("_ay")) * dx - (F.col("x") - F.col("_ax")) * dy) / n).otherwise(
        F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay")))
    interior = F.col("_ax").isNotNull() & F.col("_bx").isNotNull()
    return p.where(~interior | (off > tolerance)).select(*points.columns)


def covered_length(df: DataFrame, group: list[str], lo: str, hi: str, tie: str, blocks: int | None = None) -> DataFrame:
    """Total length of the union of intervals per group."""
    m = running_max(df, group, [F.col(lo), F.col(hi), F.col(tie)], hi, "_m", blocks)
    part = F.greatest(F.lit(0.0), F.col(hi) - F.greatest(F.col(lo), F.coalesce("_m", lo)))
    return m.groupBy(*group).agg(F.sum(part).alias("covered"))
