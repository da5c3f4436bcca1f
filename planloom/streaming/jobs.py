"""Structured Streaming jobs: debounced changes, change application, incremental edges, fact state, usage, validation.

Each job reuses the batch operators. Sinks are idempotent per micro-batch (a folder per batch id is overwritten), so a
batch that runs again after a failure gives the same tables.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from planloom.operators import keyed as K
from planloom.operators import relations as R
from planloom.operators import rules as L
from planloom.skew import salted_join
from planloom.staging import Stage


def file_stream(spark: SparkSession, path: str, schema, glob: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).parquet(path)


def run_append(df: DataFrame, name: str = "stream") -> tuple[DataFrame, list[dict]]:
    """Runs a stream over all data that is there; gives the appended table and the progress records."""
    stage = Stage(df.sparkSession, name)
    q = (df.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{stage.root}/checkpoint")
         .option("path", f"{stage.root}/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{stage.root}/out"), q.recentProgress


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], mode: str = "append", name: str = "stream") -> list[dict]:
    stage = Stage(df.sparkSession, name)
    q = (df.writeStream.outputMode(mode).foreachBatch(fn).option("checkpointLocation", f"{stage.root}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q.recentProgress


# -- P1 ---------------------------------------------------------------------------------------------------------

def debounced_sessions(changes: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of changes per project (project, start, end, n_changes), closed when the watermark passes their end.

    The state of an open session is its bounds and a count, whatever the number of changes; the changed ids are looked
    up afterwards by ``session_members``.
    """
    s = changes.withWatermark("ts", late).groupBy("project", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_changes"))
    return s.select("project", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_changes")


def session_members(changes: DataFrame, sessions: DataFrame, gap_seconds: int) -> DataFrame:
    """Distinct (project, start, changed_id) of the sessions.

    Both sides are cut into buckets of one gap. Two sessions are at least one gap apart, so a bucket meets at most two
    sessions and the join stays linear even for a project with a third of all changes.
    """
    b = lambda c: F.floor(F.unix_timestamp(c) / gap_seconds)
    few = sessions.withColumn("_b", F.explode(F.sequence(b("start"), b("end")))).select("project", "_b", "start", "end")
    many = changes.select("project", "changed_id", "ts", b("ts").alias("_b"))
    hit = salted_join(many, few, ["project", "_b"], (F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end")))
    return hit.select("project", "start", "changed_id").distinct()


# -- P2 -----------------------------------------------------------------------------------------------------------

def apply_changes(changes: DataFrame, log_path: str, key: str = "id", version: str = "version") -> list[dict]:
    """Appends the newest change per key of every micro-batch to a change log (one folder per batch).

    Merge on read: no micro-batch rewrites the table; ``current_table`` folds the log into it.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        K.latest(batch, [key], [version]).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")

    return run_batches(changes, write, name="changes")


def current_table(base: DataFrame, log: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """Base rows with the logged changes applied; ``op`` = delete sets ``deleted_at``, anything else replaces the row."""
    last = K.latest(log, [key], [version])
    cols = [c for c in base.columns if c not in (key, "deleted_at")]
    c = last.select(key, F.lit(True).alias("_c"), (F.col("op") == "delete").alias("_d"), F.col("ts").alias("_ts"), *[F.col(x).alias(f"_n_{x}") for x in cols])
    j = base.withColumn("_b", F.lit(True)).join(c, key, "full_outer")
    gone = F.coalesce("_d", F.lit(False))
    out = j.select(key, *[F.when(F.col("_c") & ~gone, F.col(f"_n_{x}")).otherwise(F.col(x)).alias(x) for x in cols],
                   F.when(F.col("_c") & gone, F.coalesce("deleted_at", "_ts")).when(F.col("_c"), F.lit(None)).otherwise(F.col("deleted_at")).alias("deleted_at"),
                   (gone & F.col("_b").isNull()).alias("_never"))
    # a delete for a key the table never had leaves no row
    return out.where("not _never").select(*base.columns)


# -- P3 -----------------------------------------------------------------------------------------------------------

class ChangeLog:
    """A table as a log of changes: a folder of added and removed rows (``op``) for each batch, the rows to start with as batch
    -1, and now and then a folder ``snap=n`` that stands for all batches up to n. A row is known by its ``key``.

    A batch's folder is overwritten as a whole, so a batch that runs again leaves the same log, and it reads batches before
    itself only. A snapshot counts once Spark has marked it as complete; the folders it replaces may then go.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folders(self, kind: str) -> list[int]:
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.fs_path(self.path))]
        found = [n for n in names if n.startswith(f"{kind}=") and self.fs.exists(self.fs_path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in found)

    def write(self, changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def start(self, rows: DataFrame) -> None:
        """Writes the rows to start with, once."""
        if not self.folders("batch") and not self.folders("snap"):
            self.write(rows.withColumn("op", F.lit("add")), -1)

    def table(self, before: int | None = None) -> DataFrame:
        """The rows after all batches, or after those before ``before``: of each key the last change, unless it removes it."""
        snap = max((n for n in self.folders("snap") if before is None or n < before), default=None)
        parts = [(n, f"{self.path}/batch={n}") for n in self.folders("batch") if (snap is None or n > snap) and (before is None or n < before)]
        if snap is not None:
            parts.append((snap, f"{self.path}/snap={snap}"))
        log = None
        for n, path in parts:
            part = self.spark.read.parquet(path).withColumn("_batch", F.lit(n))
            log = part if log is None else log.unionByName(part)
        return K.latest(log, self.key, ["_batch"]).where("op = 'add'").drop("op", "_batch")

    def compact(self) -> None:
        """Folds all batches so far into a snapshot and removes what it replaces. Not while a batch is being written."""
        batches, snaps = self.folders("batch"), self.folders("snap")
        if batches:
            last = batches[-1]
            self.table().withColumn("op", F.lit("add")).write.mode("overwrite").parquet(f"{self.path}/snap={last}")
            for kind, numbers in (("batch", batches), ("snap", snaps)):
                for n in numbers:
                    if kind == "batch" or n < last:
                        self.fs.delete(self.fs_path(f"{self.path}/{kind}={n}"), True)


EDGE_KEY = ["project_id", "from_id", "to_id", "relation_type"]


def edge_logs(spark: SparkSession, root: str) -> tuple[ChangeLog, ChangeLog]:
    """The logs of elements and edges in a folder."""
    return ChangeLog(spark, f"{root}/elements", ["id"]), ChangeLog(spark, f"{root}/edges", EDGE_KEY)


def incremental_edges(changed_elements: DataFrame, elements: DataFrame, edges: DataFrame, radius: float, layer_limit: int, root: str | None = None,
                      compact_every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Edges kept up to date while changed elements arrive; equal to a full recompute after every micro-batch.

    A micro-batch appends the changed elements and the edges that come and go to two logs in ``root``; nothing is rewritten and
    no state is kept on the driver. Started again with the same ``root``, it goes on from its checkpoint there; ``elements``
    and ``edges`` are read the first time only. Of several rows for one id in a micro-batch the greatest counts. Every
    ``compact_every`` batches the logs are folded, before the next batch is written.
    """
    spark = elements.sparkSession
    root = root or Stage(spark, "edges").root
    parts, lines = edge_logs(spark, root)
    parts.start(elements)
    lines.start(edges)

    def step(batch: DataFrame, batch_id: int) -> None:
        before, stage = parts.table(batch_id), Stage(spark, "edgefeed")
        new = stage.write(K.latest(batch.select(*elements.columns), ["id"], [c for c in elements.columns if c != "id"]))
        after = before.join(new.select("id"), "id", "left_anti").select(*elements.columns).unionByName(new)
        lines.write(R.edge_changes(lines.table(batch_id), after, new.select("id"), before, radius, layer_limit), batch_id)
        parts.write(new.withColumn("op", F.lit("add")), batch_id)

    def step_and_fold(batch: DataFrame, batch_id: int) -> None:
        if batch_id and batch_id % compact_every == 0:
            for log in (parts, lines):
                if log.folders("batch") and log.folders("batch")[-1] < batch_id:  # not when this batch runs again
                    log.compact()
        step(batch, batch_id)

    query = (changed_elements.writeStream.foreachBatch(step_and_fold).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
    query.awaitTermination()
    return parts.table(), lines.table()


# -- P4, P5, P6, P7, P8 ---------------------------------------------------------------------------------------------

#: What the state of a fact's key holds: its newest fact.
FACT_STATE = "id long, confidence double, created_at timestamp, expires_at timestamp, value string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestFact(StatefulProcessor):
    """Keeps the newest fact of each (project, type, key), tells every change, and forgets a fact when the clock of the stream
    (its watermark) passes ``expires_at``."""

    def __init__(self, names: list[str]):
        self.names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.fact = handle, handle.getValueState("fact", FACT_STATE)

    def handleInputRows(self, key, rows, timerValues):
        before = tuple(self.fact.get()) if self.fact.exists() else None
        best = before
        for batch in rows:
            for r in batch[self.names].astype(object).itertuples(index=False):
                r = tuple(None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r)
                if best is None or (r[2], r[0]) > (best[2], best[0]):  # created_at, then id
                    best = r
        now = timerValues.getCurrentWatermarkInMs()
        if best is not None and best != before:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if best[3] is not None and millis(best[3]) <= now:
                self.fact.clear()
                yield told(key, best, "expire", self.names)
            else:
                self.fact.update(best)
                if best[3] is not None:
                    self.handle.registerTimer(millis(best[3]))
                yield told(key, best, "set", self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.fact.exists():
            best = tuple(self.fact.get())
            self.fact.clear()
            yield told(key, best, "expire", self.names)

    def close(self) -> None:
        pass


def millis(t: datetime.datetime) -> int:
    return int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)


def told(key: tuple, fact: tuple, op: str, names: list[str]) -> pd.DataFrame:
    return pd.DataFrame([[*key, *fact, op]], columns=["project_id", "fact_type", "key", *names, "op"]).astype({"created_at": "datetime64[us]", "expires_at": "datetime64[us]"})


def fact_changes(facts: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream of changes (fact columns, ``op``: set or expire) to the newest fact per (project, type, key).

    The newest is that of the last ``created_at``, then of the largest id; later arrivals that are older change nothing. A fact
    with ``expires_at`` leaves the state by a timer when the watermark, ``late`` behind the newest ``created_at``, has passed
    that time; one without stays. Facts without ``created_at`` are not ordered and left out. The state is kept by RocksDB, a
    row for each key that has not expired. The session's time zone is taken to be UTC.
    """
    spark = facts.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    names = [c.split()[0] for c in FACT_STATE.split(", ")]
    rows = facts.select("project_id", "fact_type", "key", *names).where("created_at is not null").withWatermark("created_at", late)
    kinds = {f.name: f.dataType.simpleString() for f in facts.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("project_id", "fact_type", "key")) + f", {FACT_STATE}, op string"
    return rows.groupBy("project_id", "fact_type", "key").transformWithStateInPandas(NewestFact(names), schema, "Append", "EventTime")


def fact_state(facts: DataFrame, sink: str, late: str = "0 seconds") -> list[dict]:
    """Runs ``fact_changes`` over all that is there and appends the changes to ``sink``, a folder per micro-batch that a
    repeated batch overwrites. Started again with the same ``sink`` it goes on from its checkpoint, beside the changes."""
    query = (fact_changes(facts, late).writeStream.outputMode("append").option("checkpointLocation", f"{sink}.checkpoint").trigger(availableNow=True)
             .foreachBatch(lambda b, i: b.withColumn("step", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={i}")).start())
    query.awaitTermination()
    return query.recentProgress


def facts_now(log: DataFrame) -> DataFrame:
    """The facts that are set: the last change of each key, unless it is that the fact expired."""
    last = K.latest(log.drop("batch"), ["project_id", "fact_type", "key"], ["step", "created_at", "id"])
    return last.where("op = 'set'").drop("op", "step")


def usage_counts(events: DataFrame, late: str, size: str) -> DataFrame:
    """Uses and last use per alias and tumbling window."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "alias").agg(
        F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used"))
    return w.select(F.col("w.start").alias("start"), "alias", "uses", "last_used")


def dedup_events(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """One notification per key; the state of a key is dropped once the watermark has passed it."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def late_rows(progress: list[dict]) -> int:
    """Rows that stateful operators dropped because they came behind the watermark."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in progress for op in p["stateOperators"])


def validate_stream(elements: DataFrame, rules: DataFrame, sink: str) -> list[dict]:
    """Rule checks on arriving elements: the findings of every micro-batch, a folder each, which a repeated batch overwrites."""
    return run_batches(elements, lambda b, i: L.validate(b, rules).write.mode("overwrite").parquet(f"{sink}/batch={i}"), name="validate")
