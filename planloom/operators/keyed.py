"""Keyed tables: latest version per key, soft delete, purge, status updates, corrections, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.skew import join_all
from planloom.staging import Stage, remove


def latest(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key. ``max_by`` is a partial aggregate, so a key with many versions stays cheap."""
    row = F.struct(*[F.col(c) for c in df.columns])
    best = df.groupBy(*keys).agg(F.max_by(row, F.struct(*version)).alias("_r"))
    return best.select("_r.*")


def upsert(table: DataFrame, batch: DataFrame, keys: list[str], version: str = "version",
           clear: dict[str, object] | None = None) -> DataFrame:
    """Insert or overwrite by key; a row that comes in again is live again (``clear`` resets its columns)."""
    for col, value in (clear or {}).items():
        batch = batch.withColumn(col, F.lit(value).cast(table.schema[col].dataType))
    new = latest(batch.select(*table.columns), keys, [version])
    # only keys of the stored table meet the batch; its rows are not rebuilt
    return table.join(new.select(*keys), keys, "left_anti").select(*table.columns).unionByName(new.select(*table.columns))


def insert_ignore(table: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``batch`` whose key is new are added; existing rows win. A key that the batch repeats is added once, the first by its JSON form."""
    row = F.struct(*[F.col(c) for c in table.columns])
    once = batch.groupBy(*keys).agg(F.min_by(row, F.to_json(row)).alias("_r")).select("_r.*")
    return table.unionByName(once.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def soft_delete(table: DataFrame, ids: DataFrame, key: str, now: Column) -> DataFrame:
    """Sets ``deleted_at`` once on the given ids."""
    mark = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return table.join(mark, key, "left").withColumn(
        "deleted_at", F.when(F.col("_hit"), F.coalesce("deleted_at", now)).otherwise(F.col("deleted_at"))
    ).select(*table.columns)


def purge(elements: DataFrame, edges: DataFrame, projects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes projects from the element table and, by cascade, the edges of removed elements."""
    gone = projects.select("project_id").distinct()
    kept = elements.join(gone, "project_id", "left_anti")
    return kept, edges.join(gone, "project_id", "left_anti")


#: Folders that a stored table is dealt to by project.
PARTS = 64


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("project_id"), F.lit(parts)).cast("int")


def store_by_project(df: DataFrame, path: str, parts: int = PARTS) -> None:
    """Writes a table in ``parts`` folders by a hash of the project, so that a project is in one of them."""
    df.withColumn("part", part_of(parts)).write.mode("overwrite").partitionBy("part").parquet(path)


def purge_stored(spark: SparkSession, paths: list[str], projects: DataFrame, parts: int = PARTS) -> None:
    """Removes projects from tables written by ``store_by_project``: elements, then, by cascade, edges and whatever else is kept
    by project. Only folders that hold one of the projects are read and written (dynamic partition overwrite); a folder that
    is left without rows is removed. Done again, or after a failure half way, it gives the same tables."""
    gone = projects.where("project_id is not null").select("project_id").distinct()
    numbers = sorted(r[0] for r in gone.select(part_of(parts).alias("part")).distinct().collect())  # at most ``parts``
    for path in paths:
        stage = Stage(spark, "purge")
        left = stage.write(spark.read.parquet(path).where(F.col("part").isin(numbers)).join(gone, "project_id", "left_anti"))
        left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
        for n in set(numbers) - {r[0] for r in left.select("part").distinct().collect()}:
            remove(spark, f"{path}/part={n}")


def changed_files(manifest: DataFrame, seen: DataFrame) -> DataFrame:
    """Inputs whose (path, hash) has not been processed."""
    return manifest.join(seen.select("path", "hash").distinct(), ["path", "hash"], "left_anti")


def lookup_batch(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Every requested id with its row and a ``found`` flag."""
    return ids.join(table.withColumn("_f", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_f", F.lit(False))).drop("_f")


def staleness(table: DataFrame, keys: list[str], ts: str, now: Column, max_age_seconds: int) -> DataFrame:
    """Age of the newest row per key against a limit."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.max(F.col(ts).cast("timestamp")))
    return table.groupBy(*keys).agg((age / 1000000.0).alias("age_seconds")).withColumn(
        "stale", F.col("age_seconds") > max_age_seconds)


def set_status(table: DataFrame, updates: DataFrame, key: str = "id", status: str = "status", order: str | None = None) -> DataFrame:
    """Copy-on-write status change; ``updates`` holds (key, new status). Of several for one key the last by ``order`` counts,
    or the largest status if there is no order."""
    new = updates.groupBy(key).agg(F.max_by(status, order or status).alias("_s"))
    return table.join(new, key, "left").withColumn(status, F.coalesce("_s", status)).select(*table.columns)


def apply_corrections(entities: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add, remove, modify or replace entities by handle.

    ``corrections``: (correction_id, action, handle, and the entity's value columns, null = unchanged). Several
    changes of one handle apply in the order of correction_id, column by column; a removed or replaced entity takes none. Returns the new entity table and one result row per correction: a remove or
    modify without a known handle fails, a replace always creates its new row.
    """
    values = [c for c in entities.columns if c != "handle"]
    known = corrections.join(entities.select("handle", F.lit(True).alias("_k")), "handle", "left")
    known = known.withColumn("success", F.col("action").isin("add", "replace") | F.coalesce("_k", F.lit(False)))
    drop = known.where(F.col("success") & F.col("action").isin("remove", "replace")).select("handle")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("correction_id")))
    change = known.where(F.col("success") & (F.col("action") == "modify")).groupBy("handle").agg(*[last(c).alias(f"_n_{c}") for c in values])
    fresh = known.where(F.col("action").isin("add", "replace")).select(
        F.concat(F.lit("c"), F.col("correction_id")).alias("handle"), *values)
    kept = entities.join(drop, "handle", "left_anti").join(change, "handle", "left").select(
        "handle", *[F.coalesce(f"_n_{c}", c).alias(c) for c in values])
    result = known.select("correction_id", "action", "success", F.when(
        ~F.col("success"), F.lit("handle not found")).alias("error"))
    return kept.unionByName(fresh), result


def split_dataset(df: DataFrame, key: str, train: int = 80, val: int = 10) -> DataFrame:
    """Stable split by key hash; the same key always lands in the same part."""
    b = F.pmod(F.xxhash64(key), F.lit(100))
    return df.withColumn("split", F.when(b < train, "train").when(b < train + val, "val").otherwise("test"))


def live_facts(facts: DataFrame, now: Column, fact_type: str | None = None, min_confidence: float = 0.0) -> DataFrame:
    df = facts.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    if fact_type:
        df = df.where(F.col("fact_type") == fact_type)
    return df.where(F.col("confidence") >= min_confidence)


def overlay(defaults: DataFrame, user: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """User value over default; keys known to either side."""
    u = user.select(*keys, F.col(value).alias("_u"), F.lit("user").alias("_s"))
    return defaults.join(u, keys, "full_outer").select(
        *keys, F.coalesce("_u", value).alias(value), F.coalesce("_s", F.lit("default")).alias("source"))


def project_rows_or_default(projects: DataFrame, rows: DataFrame, defaults: DataFrame) -> DataFrame:
    """Own rows where a project has any, else the default rows (a small literal table)."""
    bare = projects.select("project_id").distinct().join(rows.select("project_id").distinct(), "project_id", "left_anti")
    return rows.unionByName(join_all(bare, defaults).select(*rows.columns))
