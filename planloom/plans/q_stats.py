"""Registered queries: aggregates, windows and conversation summaries."""

from pyspark.sql import functions as F

from planloom.operators import memory as M
from planloom.operators import relations as R
from planloom.operators import stats
from planloom.operators import windows as N
from planloom.plans.bind import ctes
from planloom.plans.registry import query

E = ctes("elements")


@query("file_context", "A2", E + """, d AS (SELECT project_id, unnest([('entity_type',entity_type,30),('layer',layer,30),('category',category,20),('family',family,20)]) AS s FROM elements WHERE NOT deleted),
c AS (SELECT project_id, s[1] AS dimension, s[2] AS value, max(s[3]) AS cap, count(*) AS n FROM d GROUP BY ALL)
SELECT project_id, dimension, value, n FROM (SELECT *, row_number() OVER (PARTITION BY project_id, dimension ORDER BY n DESC, value) rn FROM c) WHERE rn<=cap""")
def _(t):
    return stats.file_context(t.elements.where("not deleted"), {"entity_type": 30, "layer": 30, "category": 20, "family": 20})


@query("context_totals", "A2", E + """, x AS (SELECT p.project_id FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.id<q.id AND NOT p.deleted AND NOT q.deleted
 AND p.min_x<=q.max_x AND p.max_x>=q.min_x AND p.min_y<=q.max_y AND p.max_y>=q.min_y)
SELECT project_id, count(*) AS total_elements, count(*) FILTER (WHERE embedded) AS embedded_elements,
 (SELECT count(*) FROM x WHERE x.project_id=e.project_id) AS relationships FROM elements e WHERE NOT deleted GROUP BY project_id""")
def _(t):
    live = t.elements.where("not deleted")
    return stats.context_totals(live, R.intersecting_pairs(live))


@query("symbol_stats", "A5", "SELECT label, count(*) AS n, count(embedding) AS embedded FROM (SELECT d.doc_id%10 AS label, e.embedding FROM documents d LEFT JOIN embeddings e ON e.vec_id=d.doc_id) GROUP BY label")
def _(t):
    j = t.documents.select("doc_id").join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return j.groupBy((F.col("doc_id") % 10).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("embedded"))


@query("edge_build_stats", "A6", ctes("edges") + """, r AS (SELECT *, CASE id%4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'hvac' WHEN 2 THEN 'plumbing' END AS system, (id%10)/10e0 AS confidence FROM edges)
SELECT 'total' AS name, count(*)::DOUBLE AS value FROM r UNION ALL SELECT 'average_confidence', round(avg(confidence),9) FROM r UNION ALL SELECT 'bidirectional', count(*) FILTER (WHERE a>b) FROM r
UNION ALL SELECT 'type:'||kind, count(*) FROM r GROUP BY kind UNION ALL SELECT 'system:'||system, count(*) FROM r WHERE system<>'unknown' GROUP BY system""")
def _(t):
    system = F.when(F.col("id") % 4 == 0, "unknown").when(F.col("id") % 4 == 1, "hvac").when(F.col("id") % 4 == 2, "plumbing")
    e = t.edges.select(F.col("kind").alias("relation_type"), system.alias("system"), ((F.col("id") % 10) / 10).alias("confidence"), (F.col("a") > F.col("b")).alias("bidirectional"))
    return stats.edge_build_stats(e).withColumn("value", F.round("value", 9))


@query("entities_by", "A9", E + """, r AS (SELECT project_id, layer, id, (row_number() OVER (PARTITION BY project_id, layer ORDER BY id)-1)//10 AS block FROM elements WHERE NOT deleted)
SELECT project_id, layer, block, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r GROUP BY ALL""")
def _(t):
    m = stats.members_in_blocks(t.elements.where("not deleted"), ["project_id", "layer"], "id", 10)
    return m.withColumn("ids", F.array_join("ids", ","))


@query("required_layers", "A10", E + " SELECT DISTINCT layer FROM elements WHERE NOT deleted")
def _(t):
    return stats.required_layers(t.elements.where("not deleted"))


@query("required_blocks", "A10", E + " SELECT DISTINCT family AS block_name FROM elements WHERE entity_type='PROMO' AND NOT deleted")
def _(t):
    kind = F.when(F.col("entity_type") == "PROMO", "BLOCK").otherwise(F.col("entity_type"))
    blocks = t.elements.where("not deleted").select(kind.alias("entity_type"), F.when(F.col("entity_type") != "SMALL", F.col("family")).otherwise("").alias("block_name"))
    return stats.required_blocks(blocks)


@query("batch_status", "A13", """SELECT o_custkey AS batch, count(*) FILTER (WHERE o_orderstatus='F') AS success, count(*) FILTER (WHERE o_orderstatus='P') AS failed,
 count(*) FILTER (WHERE o_orderstatus='O') AS skipped, CASE WHEN count(*) FILTER (WHERE o_orderstatus='P')=0 THEN 'completed' WHEN count(*) FILTER (WHERE o_orderstatus='F')=0 THEN 'failed' ELSE 'partial' END AS status FROM orders GROUP BY o_custkey""")
def _(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    g = t.orders.groupBy(F.col("o_custkey").alias("batch")).agg(n("F").alias("success"), n("P").alias("failed"), n("O").alias("skipped"))
    return g.withColumn("status", F.when(F.col("failed") == 0, "completed").when(F.col("success") == 0, "failed").otherwise("partial"))


@query("issues_by_type", "A14", """SELECT o_orderpriority AS issue_type, count(*) FILTER (WHERE o_orderstatus='F') AS critical, count(*) FILTER (WHERE o_orderstatus='O') AS major,
 count(*) FILTER (WHERE o_orderstatus='P') AS minor FROM orders GROUP BY o_orderpriority""")
def _(t):
    p = t.orders.groupBy(F.col("o_orderpriority").alias("issue_type")).pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return p.withColumnsRenamed({"F": "critical", "O": "major", "P": "minor"})


@query("validation_report", "A22", """WITH r AS (SELECT c_custkey AS drawing, count(o_orderkey) AS n, count(*) FILTER (WHERE o_orderstatus='F') AS f, count(*) FILTER (WHERE o_orderstatus='O') AS o, count(*) FILTER (WHERE o_orderstatus='P') AS p FROM customer LEFT JOIN orders ON o_custkey=c_custkey GROUP BY ALL)
SELECT drawing, 'Validation Status: '||CASE WHEN n=0 THEN 'approved' ELSE 'needs_correction' END||chr(10)||'Accuracy Estimate: '||(100-n%40)||'%'||chr(10)||'Iterations: '||(n%3+1)||'/3'||chr(10)||chr(10)||
 CASE WHEN n=0 THEN 'Result: APPROVED - Extraction validated successfully!' ELSE 'Issues Found: '||n||chr(10)||'  - Critical: '||f||chr(10)||'  - Major: '||o||chr(10)||'  - Minor: '||p||
 CASE WHEN f>0 THEN chr(10)||chr(10)||'Corrections Suggested: '||f||chr(10)||'Corrections Applied: '||f//2 ELSE '' END END AS report FROM r""")
def _(t):
    n = lambda s: F.count_if(F.col("o_orderstatus") == s)
    r = t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy(F.col("c_custkey").alias("drawing")).agg(
        F.count("o_orderkey").alias("issues"), n("F").alias("critical"), n("O").alias("major"), n("P").alias("minor"))
    r = r.withColumns({"approved": F.col("issues") == 0, "accuracy": (100 - F.col("issues") % 40) + F.lit(0.25), "iteration": F.col("issues") % 3 + 1, "max_iterations": F.lit(3),
                       "corrections": F.col("critical"), "applied": F.floor(F.col("critical") / 2)})
    return stats.validation_report(r.withColumn("status", F.when(F.col("approved"), "approved").otherwise("needs_correction"))).select("drawing", "report")


@query("summarize_conversation", "A16 C15", """WITH o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations),
old AS (SELECT * FROM o WHERE rn>4), topics AS (SELECT conv_id, trim(text[1:50], ' ') AS topic, min(turn) AS turn FROM old WHERE role='user' AND length(trim(text[1:50],' '))>0 GROUP BY ALL),
acts AS (SELECT conv_id, act, min(turn) AS turn FROM (SELECT conv_id, turn, string_split(trim(text),' ')[1] AS act FROM old WHERE role='assistant') WHERE act<>'' GROUP BY ALL),
aa AS (SELECT conv_id, string_agg(act,', ' ORDER BY turn, act) AS a FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, act) rn FROM acts) WHERE rn<=10 GROUP BY conv_id),
tt AS (SELECT conv_id, string_agg(topic,'; ' ORDER BY turn) AS t FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) rn FROM topics) WHERE rn<=3 GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS messages_summarized, sum(length(text)//4)::BIGINT AS old_tokens, count(*) FILTER (WHERE role='assistant' AND (contains(lower(text),'error') OR contains(lower(text),'failed'))) AS errors FROM old GROUP BY conv_id),
u AS (SELECT s.*, CASE WHEN t IS NULL AND a IS NULL AND errors=0 THEN '[Previous conversation context]' ELSE concat_ws('. ', 'Topics: '||t, 'Actions: '||a, CASE WHEN errors>0 THEN 'Errors encountered: '||errors END) END AS summary FROM s LEFT JOIN tt USING (conv_id) LEFT JOIN aa USING (conv_id))
SELECT conv_id, messages_summarized, errors, CASE WHEN length(summary)>160 THEN summary[1:157]||'...' ELSE summary END AS summary,
 old_tokens - (CASE WHEN length(summary)>160 THEN 160 ELSE length(summary) END)//4 AS tokens_saved FROM u""")
def _(t):
    tool = F.array_compact(F.array(F.when(F.trim("text") != "", F.split(F.trim("text"), " ")[0])))  # the first word stands for the tool an answer called
    return M.summarize_conversation(t.conversations.withColumn("tool_calls", tool), keep=4, max_tokens=40, error_role="assistant")


@query("degree", "A20", ctes("edges") + " SELECT node, count(*) AS degree FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node")
def _(t):
    return stats.degree(t.edges)


@query("drawing_bounds", "A19", ctes("segments") + " SELECT project_id, min(least(x1,x2)) AS min_x, min(least(y1,y2)) AS min_y, max(greatest(x1,x2)) AS max_x, max(greatest(y1,y2)) AS max_y FROM segments GROUP BY project_id")
def _(t):
    return stats.drawing_bounds(t.segments, ["project_id"], ["x1", "x2"], ["y1", "y2"])


@query("layer_audit", "A21", E + """, l AS (SELECT 'Brand#'||n_nationkey AS layer, n_regionkey=0 AS frozen, n_regionkey=1 AS locked FROM nation)
SELECT l.layer, frozen, locked, count(e.id) AS n, count(e.id)=0 AS empty FROM l LEFT JOIN elements e ON e.layer=l.layer AND NOT e.deleted GROUP BY l.layer, frozen, locked""")
def _(t):
    layers = t.nation.select(F.concat(F.lit("Brand#"), "n_nationkey").alias("layer"), (F.col("n_regionkey") == 0).alias("frozen"),
                             (F.col("n_regionkey") == 1).alias("locked"))
    counts = t.elements.where("not deleted").groupBy("layer").agg(F.count(F.lit(1)).alias("n"))
    j = layers.join(counts, "layer", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.withColumn("empty", F.col("n") == 0)


# -- W ------------------------------------------------------------------------------------------------

ROWS = """h AS (SELECT project_id, CASE WHEN y1=y2 THEN 'h' ELSE 'v' END AS axis, CASE WHEN y1=y2 THEN y1 ELSE x1 END AS line, CASE WHEN y1=y2 THEN x1 ELSE y1 END AS lo, CASE WHEN y1=y2 THEN x2 ELSE y2 END AS hi, id FROM segments),
g AS (SELECT *, lo - lag(hi) OVER (PARTITION BY project_id, axis, line ORDER BY lo, hi, id) AS gap FROM h)"""
LINE = ["project_id", "axis", "line"]


def lines1d(t):
    """Horizontal lines by their y, all others (the drawings have vertical ones) by their x."""
    flat = F.col("y1") == F.col("y2")
    pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
    return t.segments.select("project_id", F.when(flat, "h").otherwise("v").alias("axis"), pick("y1", "x1").alias("line"), pick("x1", "y1").alias("lo"), pick("x2", "y2").alias("hi"), "id")


@query("interval_gaps", "W1", ctes("segments") + f", {ROWS} SELECT project_id, axis, line, id, gap FROM g WHERE gap>0")
def _(t):
    return N.interval_gaps(lines1d(t), LINE, "lo", "hi", "id").select(*LINE, "id", "gap")


@query("is_dashed", "W2", ctes("segments") + f""", {ROWS}, b AS (SELECT * FROM g WHERE gap>=2), m AS (SELECT project_id, axis, line, count(*) AS n_gaps, avg(gap) AS mean_gap FROM b GROUP BY ALL)
SELECT m.project_id, m.axis, m.line, n_gaps, mean_gap, any_value(n_gaps)>=2 AND max(abs(gap-mean_gap))<=0.3*any_value(mean_gap) AS dashed FROM m JOIN b USING (project_id, axis, line) GROUP BY m.project_id, m.axis, m.line, n_gaps, mean_gap""")
def _(t):
    return N.is_dashed(N.interval_gaps(lines1d(t), LINE, "lo", "hi", "id"), LINE)


def boxes(t):
    a = t.annotations
    return a.select("id", "project_id", "x", (F.floor(F.col("y") / 40) * 40 + F.col("y") % 2).alias("y"),
                    (F.length("text") * 3.0).alias("width"), "text", ((F.col("id") % 10) / 10).alias("confidence"))


@query("merge_adjacent_texts", "W3", ctes("annotations") + """, b AS (SELECT id, project_id, x, floor(y/40)*40+y%2 AS y, length(text)*3e0 AS width, text, (id%10)/10e0 AS confidence FROM annotations),
l AS (SELECT *, lag(x+width) OVER w AS px, lag(y) OVER w AS py FROM b WINDOW w AS (PARTITION BY project_id ORDER BY round(y,1), x, id)),
r AS (SELECT *, sum(CASE WHEN px IS NULL OR abs(y-py)>2 OR x-px>5 THEN 1 ELSE 0 END) OVER (PARTITION BY project_id ORDER BY round(y,1), x, id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM l)
SELECT project_id, run, min(id) AS first_id, min(x) AS x, avg(y) AS y, max(x+width) AS "right", min(confidence) AS confidence, count(*) AS n_texts, string_agg(text,' ' ORDER BY round(y,1), x, id) AS text FROM r GROUP BY ALL""")
def _(t):
    return N.merge_adjacent_texts(boxes(t), ["project_id"])


@query("token_budget", "W5 C15", ctes("facts") + """ SELECT project_id, id, used FROM (SELECT *, sum((length(value)+length(key))//4) OVER (PARTITION BY project_id ORDER BY confidence DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM facts) WHERE used<=500""")
def _(t):
    return N.token_budget(t.facts, ["project_id"], [F.desc("confidence"), F.col("id")], F.concat("key", "value"), 500).select("project_id", "id", "used")


PTS = "p AS (SELECT user_id AS line, event_id AS seq, (event_id*37%100)::DOUBLE AS x, floor(value/50)*50 AS y FROM events)"


def points(t):
    return t.events.select(F.col("user_id").alias("line"), F.col("event_id").alias("seq"), (F.col("event_id") * 37 % 100).cast("double").alias("x"),
                           (F.floor(F.col("value") / 50) * 50).cast("double").alias("y"))


@query("polyline_length", "W7", f"WITH {PTS} SELECT line, coalesce(sum(d),0) AS length, count(*) AS n_points FROM (SELECT line, sqrt((x-lag(x) OVER w)^2+(y-lag(y) OVER w)^2) AS d FROM p WINDOW w AS (PARTITION BY line ORDER BY seq)) GROUP BY line")
def _(t):
    return N.polyline_length(points(t), ["line"])


@query("drop_collinear", "W7", f"""WITH {PTS}, n AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS bb FROM p WINDOW w AS (PARTITION BY line ORDER BY seq))
SELECT line, seq, x, y FROM n WHERE ax IS NULL OR bx IS NULL OR CASE WHEN sqrt((bx-ax)^2+(bb-ay)^2)>0 THEN abs((y-ay)*(bx-ax)-(x-ax)*(bb-ay))/sqrt((bx-ax)^2+(bb-ay)^2) ELSE sqrt((x-ax)^2+(y-ay)^2) END > 3""")
def _(t):
    return N.drop_collinear(points(t), ["line"], 3.0)


@query("best_label", "W8", "SELECT o_custkey AS grp, arg_max(o_orderpriority, (o_totalprice, -o_orderkey)) AS label FROM orders GROUP BY o_custkey")
def _(t):
    return t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(F.max_by("o_orderpriority", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("label"))


@query("trim_history", "W9", """SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS f, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE f=1 OR r<=3""")
def _(t):
    return N.trim_history(t.conversations, 3).select("conv_id", "turn", "role")


@query("covered_length", "W1", ctes("segments") + f""", {ROWS}, m AS (SELECT *, max(hi) OVER (PARTITION BY project_id, axis, line ORDER BY lo, hi, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM h)
SELECT project_id, axis, line, sum(greatest(0e0, hi-greatest(lo, coalesce(m,lo)))) AS covered FROM m GROUP BY project_id, axis, line""")
def _(t):
    return N.covered_length(lines1d(t), LINE, "lo", "hi", "id")
