"""Registered queries: streaming jobs run over the driver tables as file streams."""

from pyspark.sql import functions as F

from planloom.operators import keyed as K
from planloom.operators import relations as R
from planloom.operators import rules as L
from planloom.plans import q_relations, q_rules
from planloom.plans.bind import VIEWS, ctes
from planloom.plans.registry import query
from planloom.staging import Stage, materialize
from planloom.streaming import jobs as J


def stream(t, name):
    df = J.file_stream(t.spark, t.sf_dir, getattr(t, name).schema, f"{name}.parquet")
    return timed(df) if name == "events" else df


def timed(df):
    """Event time as a zoned timestamp, which watermarks need; results go back to the tables' zone-free type."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def zone_free(df):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, k in df.dtypes if k == "timestamp"})


def changes(df):
    return df.select(F.col("user_id").alias("project"), F.col("event_id").alias("changed_id"), "ts")


SES = """WITH l AS (SELECT user_id AS project, event_id AS changed_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR ts-p>=INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY project ORDER BY ts, changed_id) AS run FROM l),
s AS (SELECT project, run, min(ts) AS start, max(ts)+INTERVAL 6 HOUR AS "end", count(*) AS n_changes FROM r GROUP BY project, run),
closed AS (SELECT * FROM s WHERE date_trunc('millisecond', "end")<=(SELECT date_trunc('millisecond', max(ts)) FROM events)-INTERVAL 10 MINUTE)"""


@query("debounced_changes", "P1", SES + ' SELECT project, start, "end", n_changes FROM closed')
def _(t):
    return zone_free(J.run_append(J.debounced_sessions(changes(stream(t, "events")), "6 hours", "10 minutes"), "sessions")[0])


@query("session_members", "P1", SES + " SELECT DISTINCT r.project, c.start, r.changed_id FROM r JOIN closed c ON c.project=r.project AND c.run=r.run")
def _(t):
    s = J.run_append(J.debounced_sessions(changes(stream(t, "events")), "6 hours", "10 minutes"), "sessions")[0]
    return zone_free(J.session_members(changes(timed(t.events)), s, 6 * 3600))


@query("apply_changes", "P2", """WITH base AS (SELECT c_custkey AS id, c_name AS name, CAST(NULL AS TIMESTAMP) AS deleted_at FROM customer),
ch AS (SELECT event_id%700*3 AS id, 'v'||event_id AS name, event_id AS version, ts, CASE WHEN event_type='error' THEN 'delete' ELSE 'upsert' END AS op FROM events),
l AS (SELECT id, arg_max(name,version) AS name, arg_max(ts,version) AS ts, arg_max(op,version) AS op FROM ch GROUP BY id)
SELECT coalesce(b.id,l.id) AS id, CASE WHEN l.op='upsert' THEN l.name ELSE b.name END AS name, CASE WHEN l.op='delete' THEN l.ts END AS deleted_at FROM base b FULL JOIN l ON l.id=b.id WHERE b.id IS NOT NULL OR l.op='upsert'""")
def _(t):
    base = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(None).cast("timestamp").alias("deleted_at"))
    k = F.col("event_id")
    ch = stream(t, "events").select((k % 700 * 3).alias("id"), F.concat(F.lit("v"), k).alias("name"), k.alias("version"), "ts",
                                    F.when(F.col("event_type") == "error", "delete").otherwise("upsert").alias("op"))
    log = f"{Stage(t.spark, 'log').root}/changes"
    J.apply_changes(ch, log)
    return zone_free(J.current_table(base, t.spark.read.parquet(log).drop("batch")))


@query("incremental_edges", "P3", ctes("elements").replace("elements AS", "raw AS") + """,
elements AS (SELECT * REPLACE (CASE WHEN size BETWEEN 20 AND 27 THEN x+0.5 ELSE x END AS x, CASE WHEN size BETWEEN 20 AND 27 THEN min_x+0.5 ELSE min_x END AS min_x,
 CASE WHEN size BETWEEN 20 AND 27 THEN max_x+0.5 ELSE max_x END AS max_x) FROM raw) """ + q_relations.ALL)
def _(t):
    cols = ["id", "project_id", "layer", "x", "y", "z", "min_x", "min_y", "max_x", "max_y"]
    base = t.elements.where("not deleted").select(*cols)
    edges = materialize(R.all_edges(base, q_relations.RADIUS, q_relations.LAYER_LIMIT))
    moved = stream(t, "part").selectExpr(*[f"{e} AS {c}" for c, e, _ in VIEWS["elements"][1]]).where("not deleted and size between 20 and 27")
    for c in ("x", "min_x", "max_x"):
        moved = moved.withColumn(c, F.col(c) + 0.5)
    return J.incremental_edges(moved.select(*cols), base, edges, q_relations.RADIUS, q_relations.LAYER_LIMIT)[1]


@query("fact_state", "P4 F8", ctes("facts") + """, l AS (SELECT project_id, fact_type, key, arg_max(id,(created_at,id)) AS id, arg_max(confidence,(created_at,id)) AS confidence FROM facts GROUP BY ALL)
SELECT l.* FROM l JOIN facts f ON f.id=l.id WHERE f.expires_at IS NULL OR epoch_ms(f.expires_at)>(SELECT epoch_ms(max(created_at)) FROM facts)""")
def _(t):
    """The facts that are live when the stream's clock has come to the newest one."""
    f = stream(t, "events").selectExpr(*[f"{e} AS {c}" for c, e, _ in VIEWS["facts"][1]])
    sink = f"{Stage(t.spark, 'facts').root}/state"
    J.fact_state(f, sink)
    return J.facts_now(t.spark.read.parquet(sink)).select("project_id", "fact_type", "key", "id", "confidence")


@query("usage_counts", "P5", """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS alias, count(*) AS uses, max(ts) AS last_used FROM events
 GROUP BY ALL HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts))+INTERVAL 1 HOUR<=(SELECT date_trunc('millisecond', max(ts)) FROM events)-INTERVAL 10 MINUTE""")
def _(t):
    e = stream(t, "events").select(F.col("event_type").alias("alias"), "ts")
    return zone_free(J.run_append(J.usage_counts(e, "10 minutes", "1 hour"), "usage")[0])


@query("dedup_events", "P6", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    e = stream(t, "events").select("user_id", "event_type", "ts")
    return J.run_append(J.dedup_events(e, ["user_id", "event_type"], "60 days"), "dedup")[0].select("user_id", "event_type")


@query("late_rows", "P7", """WITH m AS (SELECT min(ts)+(max(ts)-min(ts))/2 AS mid, date_trunc('millisecond', max(ts)) AS hi FROM events)
SELECT count(*) FILTER (WHERE ts<mid AND date_trunc('millisecond', ts)<=hi-INTERVAL 10 MINUTE) AS late, count(*) FILTER (WHERE ts>=mid) AS kept FROM events, m""")
def _(t):
    """The later half of the events arrives first (in two batches, since a watermark counts from the batch after
    next), so the earlier half is behind the watermark."""
    e = timed(t.events.select("event_id", "ts"))
    lo, hi = e.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
    mid = lo + (hi - lo) // 2
    us, cut = F.unix_micros("ts"), mid + (hi - mid) // 2
    root = f"{Stage(t.spark, 'late').root}/in"
    n = t.spark.sparkContext.defaultParallelism
    for part in (us >= cut, (us >= mid) & (us < cut), us < mid):
        e.where(part).repartition(n).write.mode("append").parquet(root)  # n files each, and n files a batch
    s = J.file_stream(t.spark, root, e.schema, files_per_trigger=n)
    out, progress = J.run_append(J.dedup_events(s, ["event_id"], "10 minutes"), "late")
    return out.agg(F.lit(J.late_rows(progress)).cast("long").alias("late"), F.count(F.lit(1)).alias("kept"))


@query("validate_stream", "P8", f"WITH {q_rules.MATCH} SELECT id, rule_name, status FROM v WHERE status IS NOT NULL")
def _(t):
    class Live:
        part = stream(t, "part")
    sink = f"{Stage(t.spark, 'validate').root}/found"
    J.validate_stream(q_rules.checked(Live), L.rule_table(t.spark, q_rules.RULES), sink)
    return t.spark.read.parquet(sink).select("id", "rule_name", "status")
