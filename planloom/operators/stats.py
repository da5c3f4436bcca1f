"""Aggregate reports over edges, elements, results and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.ordered import first_n, row_index


def relationship_stats(edges: DataFrame) -> DataFrame:
    """Count and distance statistics per relation type plus a total row (type ``*``), in one pass."""
    g = edges.rollup("relation_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("distance").alias("avg_distance"),
        F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))
    return g.withColumn("relation_type", F.coalesce("relation_type", F.lit("*")))


def file_context(elements: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Most frequent values per dimension and project: one scan, one aggregate over (dimension, value)."""
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in limits])
    counts = (elements.select("project_id", F.explode(dims).alias("d")).select("project_id", "d.*")
              .where(F.col("value").isNotNull()).groupBy("project_id", "dimension", "value").count())
    top = first_n(counts, ["project_id", "dimension"], [F.desc("count"), F.col("value")], max(limits.values()))
    cap = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])
    return top.where(F.col("rn") <= cap[F.col("dimension")]).select(
        "project_id", "dimension", "value", F.col("count").alias("n"))


def context_totals(elements: DataFrame, edges: DataFrame) -> DataFrame:
    e = elements.groupBy("project_id").agg(F.count(F.lit(1)).alias("total_elements"),
                                           F.count_if("embedded").alias("embedded_elements"))
    r = edges.groupBy("project_id").agg(F.count(F.lit(1)).alias("relationships"))
    return e.join(r, "project_id", "left").withColumn("relationships", F.coalesce("relationships", F.lit(0)))


def edge_build_stats(edges: DataFrame) -> DataFrame:
    """(name, value) rows of inferred edges (relation_type, system, confidence, bidirectional): total, average confidence (0 for
    none), bidirectional edges, and how many there are of each type and of each known system. One pass; rows, not a map."""
    total = edges.agg(F.count(F.lit(1)).cast("double").alias("total"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"),
                      F.count_if("bidirectional").cast("double").alias("bidirectional"))
    flat = total.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in total.columns])).alias("r")).select("r.*")
    kinds = F.array(F.concat(F.lit("type:"), "relation_type"), F.when(F.col("system") != "unknown", F.concat(F.lit("system:"), "system")))
    counts = edges.select(F.explode(F.array_compact(kinds)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return flat.unionByName(counts)


def required_layers(entities: DataFrame) -> DataFrame:
    """The distinct layers that entities need, in order."""
    return entities.select("layer").distinct().orderBy("layer")


def required_blocks(entities: DataFrame, entity_type: str = "block") -> DataFrame:
    """The distinct, not empty block names of block entities (type in any case of letters), in order."""
    named = entities.where((F.lower("entity_type") == entity_type) & F.col("block_name").isNotNull() & (F.col("block_name") != ""))
    return named.select("block_name").distinct().orderBy("block_name")


def validation_report(results: DataFrame) -> DataFrame:
    """``results`` (status, accuracy, iteration, max_iterations, approved, issues, critical, major, minor, corrections, applied)
    with the lines of a report as ``report``."""
    line = lambda name, *v: F.concat(F.lit(name), *[F.col(c).cast("string") if isinstance(c, str) else c for c in v])
    found = F.concat_ws("\n", line("Issues Found: ", "issues"), line("  - Critical: ", "critical"), line("  - Major: ", "major"), line("  - Minor: ", "minor"),
                        F.when(F.col("corrections") > 0, F.concat_ws("\n", F.lit(""), line("Corrections Suggested: ", "corrections"), line("Corrections Applied: ", "applied"))))
    head = F.concat_ws("\n", line("Validation Status: ", "status"), F.concat(F.lit("Accuracy Estimate: "), F.bround("accuracy", 0).cast("long").cast("string"), F.lit("%")),
                       F.concat(F.lit("Iterations: "), F.col("iteration").cast("string"), F.lit("/"), F.col("max_iterations").cast("string")), F.lit(""))
    return results.withColumn("report", F.concat_ws("\n", head, F.when(F.col("approved"), "Result: APPROVED - Extraction validated successfully!").otherwise(found)))


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def drawing_bounds(df: DataFrame, keys: list[str], xs: list[str], ys: list[str]) -> DataFrame:
    """Overall min/max of the coordinates of each drawing."""
    lo = lambda cs: F.min(F.least(*cs) if len(cs) > 1 else F.col(cs[0]))
    hi = lambda cs: F.max(F.greatest(*cs) if len(cs) > 1 else F.col(cs[0]))
    return df.groupBy(*keys).agg(lo(xs).alias("min_x"), lo(ys).alias("min_y"), hi(xs).alias("max_x"), hi(ys).alias("max_y"))


def degree(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges per node; the partial count before the shuffle keeps hubs cheap."""
    ends = edges.select(F.explode(F.array(a, b)).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def members_in_blocks(df: DataFrame, keys: list[str], id: str, block: int = 1000, blocks: int | None = None) -> DataFrame:
    """Ids per group as lists of at most ``block`` ids, numbered in id order; a large group is many rows."""
    i = row_index(df.select(*keys, id), keys, [F.col(id)], "_i", blocks)
    i = i.withColumn("block", F.floor((F.col("_i") - 1) / block))
    return i.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(id)).alias("ids"))
