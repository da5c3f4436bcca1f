"""Registered queries: duplicate suppression, fusion, matching, cleaning and refining."""

from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.operators import cleanup as C
from planloom.operators import dedup as D
from planloom.plans import oracle
from planloom.plans.bind import ctes
from planloom.plans.registry import query

SEG = ctes("segments", recursive=True)
SYM = ctes("symbols", recursive=True)
ELE = ctes("elements", recursive=True)
NEAR = "sqrt((k.x-u.x)^2+(k.y-u.y)^2)"


@query("nms_distance", "D1 D4", SYM + ", " + oracle.greedy("symbols", "confidence DESC, id", f"{NEAR}<30") + " SELECT project_id, id FROM kept")
def _(t):
    return D.nms_distance(t.symbols, 30.0).select("project_id", "id")


IW = "greatest(0e0, least(k.max_x,u.max_x)-greatest(k.min_x,u.min_x))*greatest(0e0, least(k.max_y,u.max_y)-greatest(k.min_y,u.min_y))"
AREA = "({0}.max_x-{0}.min_x)*({0}.max_y-{0}.min_y)"
BIG = "b AS (SELECT id, project_id, min_x-5 AS min_x, min_y-5 AS min_y, max_x+5 AS max_x, max_y+5 AS max_y, size/50e0 AS confidence FROM elements)"


@query("nms_iou", "D5", ELE + f", {BIG}, " + oracle.greedy("b", "confidence DESC, id", f"{IW}/({AREA.format('k')}+{AREA.format('u')}-{IW})>0.3") + " SELECT project_id, id FROM kept")
def _(t):
    b = t.elements.select("id", "project_id", (F.col("min_x") - 5).alias("min_x"), (F.col("min_y") - 5).alias("min_y"),
                          (F.col("max_x") + 5).alias("max_x"), (F.col("max_y") + 5).alias("max_y"), (F.col("size") / 50).alias("confidence"))
    return D.nms_iou(b, 0.3).select("project_id", "id")


LEN = "l AS (SELECT *, sqrt((x2-x1)^2+(y2-y1)^2) AS len, y2>y1 AS vertical FROM segments)"


@query("dedup_lines_overlap", "D6", SEG + f", {LEN}, " + oracle.greedy("l", "len DESC, id", """k.vertical=u.vertical AND
 CASE WHEN k.vertical THEN abs(u.x1-k.x1)<15 AND u.y2>=k.y1-15 AND u.y1<=k.y2+15 ELSE abs(u.y1-k.y1)<15 AND u.x2>=k.x1-15 AND u.x1<=k.x2+15 END""") + " SELECT project_id, id FROM kept")
def _(t):
    # the view's lines are horizontal or vertical, which the oracle uses
    return D.dedup_lines_overlap(t.segments).select("project_id", "id")


CIRC = "ci AS (SELECT id, project_id, x*2 AS cx, y*2 AS cy, (size%30+5)::DOUBLE AS radius, CASE WHEN id%2=0 THEN 'direct' ELSE 'selective_opencv' END AS source, CASE WHEN id%5=0 THEN '0' ELSE layer END AS layer, (size%10)/10e0 AS confidence FROM elements)"


def circles(t):
    return t.elements.select("id", "project_id", (F.col("x") * 2).alias("cx"), (F.col("y") * 2).alias("cy"), (F.col("size") % 30 + 5).cast("double").alias("radius"),
                             F.when(F.col("id") % 2 == 0, "direct").otherwise("selective_opencv").alias("source"),
                             F.when(F.col("id") % 5 == 0, "0").otherwise(F.col("layer")).alias("layer"), ((F.col("size") % 10) / 10).alias("confidence"))


@query("dedup_circles", "D7", ELE + f", {CIRC}, " + oracle.greedy("ci", "id", "sqrt((k.cx-u.cx)^2+(k.cy-u.cy)^2)<30 AND abs(k.radius-u.radius)<20") + " SELECT project_id, id FROM kept")
def _(t):
    return D.dedup_circles(circles(t)).select("project_id", "id")


def ends(tol):
    d = lambda i, j: f"sqrt((k.x{i}-u.x{j})^2+(k.y{i}-u.y{j})^2)<{tol}"
    return f"({d(1, 1)} AND {d(2, 2)}) OR ({d(1, 2)} AND {d(2, 1)})"


@query("dedup_lines_endpoints", "D8", SEG + ", " + oracle.greedy("segments", "id", ends(12)) + " SELECT project_id, id FROM kept")
def _(t):
    return D.dedup_lines_endpoints(t.segments, 12.0).select("project_id", "id")


FL = "f AS (SELECT *, CASE WHEN source='direct' THEN 0 ELSE 1 END AS rank, CASE WHEN id%4=0 THEN '0' ELSE layer END AS lay, CASE WHEN linetype='CONTINUOUS' THEN 'Continuous' ELSE linetype END AS lt FROM segments)"
FUSED = oracle.clusters("f", "rank, id", ends(12)) + """,
m AS (SELECT cl.seed, cl.project_id, f.*, (f.id<>cl.seed)::INT*1000000000000+rank*100000000000+f.id AS seq FROM cl JOIN f ON f.id=cl.id WHERE f.id=cl.seed OR f.source='selective_opencv'),
fused AS (SELECT seed AS id, any_value(project_id) AS project_id, arg_max(x1,seq) AS x1, arg_max(y1,seq) AS y1, arg_max(x2,seq) AS x2, arg_max(y2,seq) AS y2,
 coalesce(arg_min(lay,seq) FILTER (WHERE lay<>'0'), arg_max(lay,seq)) AS layer, coalesce(arg_max(lt,seq) FILTER (WHERE lt<>'Continuous'), arg_max(lt,seq)) AS linetype, count(*) AS members FROM m GROUP BY seed)"""


def sourced(t):
    return t.segments.withColumns({"layer": F.when(F.col("id") % 4 == 0, "0").otherwise(F.col("layer")),
                                   "linetype": F.when(F.col("linetype") == "CONTINUOUS", "Continuous").otherwise(F.col("linetype"))})


@query("fuse_lines", "D2 D9", SEG + f", {FL}, {FUSED} SELECT id, x1, y1, x2, y2, layer, linetype, members FROM fused")
def _(t):
    return D.fuse_lines(sourced(t), 12.0).select("id", "x1", "y1", "x2", "y2", "layer", "linetype", "members")


@query("fuse_circles", "D10", ELE + f", {CIRC}, fc AS (SELECT *, CASE WHEN source='direct' THEN 0 ELSE 1 END AS rank FROM ci), " + oracle.clusters(
    "fc", "rank, id", "sqrt((k.cx-u.cx)^2+(k.cy-u.cy)^2)<12 AND abs(k.radius-u.radius)<12") + """,
m AS (SELECT cl.seed, fc.*, (fc.id<>cl.seed)::INT*1000000000000+rank*100000000000+fc.id AS seq FROM cl JOIN fc ON fc.id=cl.id WHERE fc.id=cl.seed OR fc.source='selective_opencv')
SELECT seed AS id, arg_max(cx,seq) AS cx, arg_max(cy,seq) AS cy, arg_max(radius,seq) AS radius, coalesce(arg_min(layer,seq) FILTER (WHERE layer<>'0'), arg_max(layer,seq)) AS layer, count(*) AS members FROM m GROUP BY seed""")
def _(t):
    return D.fuse_circles(circles(t), 12.0).select("id", "cx", "cy", "radius", "layer", "members")


@query("fuse_entities", "D11", SEG + f", {FL}, {FUSED} SELECT 'line' AS kind, count(*) AS n FROM fused UNION ALL SELECT 'text', count(*) FROM customer")
def _(t):
    e = sourced(t).withColumn("kind", F.lit("line")).unionByName(
        t.annotations.select("id", "project_id", F.lit("text").alias("kind"), F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(0.0).alias("radius")),
        allowMissingColumns=True)
    return D.fuse_entities(e, 12.0).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("merge_ellipses", "D12", ELE + f", {CIRC}, " + oracle.clusters("ci", "id", "sqrt((k.cx-u.cx)^2+(k.cy-u.cy)^2)<25 AND abs(k.radius-u.radius)/greatest(k.radius,1)<0.5") + """
SELECT cl.seed AS group_id, arg_max(ci.id, (ci.confidence, -ci.id)) AS id, count(*) AS members FROM cl JOIN ci ON ci.id=cl.id GROUP BY cl.seed""")
def _(t):
    return D.merge_ellipses(circles(t).withColumnRenamed("radius", "semi_major"), 25.0, 0.5).select("group_id", "id", "members")


@query("merge_junctions", "D13", SYM + ", " + oracle.clusters("symbols", "id", f"{NEAR}<30") + """
SELECT cl.seed AS id, CASE WHEN sum(s.confidence)>0 THEN sum(s.x*s.confidence)/sum(s.confidence) ELSE avg(s.x) END AS x, CASE WHEN sum(s.confidence)>0 THEN sum(s.y*s.confidence)/sum(s.confidence) ELSE avg(s.y) END AS y,
 max(s.confidence) AS confidence, arg_max(s.kind, (s.confidence, -s.id)) AS kind, count(*) AS members FROM cl JOIN symbols s ON s.id=cl.id GROUP BY cl.seed""")
def _(t):
    return D.merge_junctions(t.symbols, 30.0).drop("project_id")


ANCH = ctes("annotations", recursive=True) + """, bx AS (SELECT id, project_id, x+id%7 AS x, y+id%5 AS y, CASE WHEN id%4=0 THEN replace(text,'0','O') WHEN id%4=1 THEN lower(text) ELSE text||'.' END AS text FROM annotations),
nt AS (SELECT *, replace(replace(lower(text),'|','l'),'0','o') AS t FROM annotations), nb AS (SELECT *, replace(replace(lower(text),'|','l'),'0','o') AS t FROM bx),
cand AS (SELECT a.project_id, a.id AS text_id, list(b.id ORDER BY 1-levenshtein(a.t,b.t)::DOUBLE/greatest(length(a.t),length(b.t)) DESC, b.id) AS bs FROM nt a JOIN nb b ON a.project_id=b.project_id AND sqrt((a.x-b.x)^2+(a.y-b.y)^2)<=60
 AND 1-levenshtein(a.t,b.t)::DOUBLE/greatest(length(a.t),length(b.t))>=0.5 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY text_id) AS rk FROM cand),
w AS (SELECT project_id, 0::BIGINT AS rk, []::BIGINT[] AS used, 0::BIGINT AS text_id, NULL::BIGINT AS box_id FROM (SELECT DISTINCT project_id FROM r) UNION ALL
 SELECT w.project_id, w.rk+1, CASE WHEN p.b IS NULL THEN w.used ELSE list_append(w.used, p.b) END, p.text_id, p.b FROM w JOIN r ON r.project_id=w.project_id AND r.rk=w.rk+1,
 LATERAL (SELECT r.text_id, list_filter(r.bs, lambda q: NOT list_contains(w.used, q))[1] AS b) p),
matches AS (SELECT w.text_id, w.box_id, 1-levenshtein(a.t,b.t)::DOUBLE/greatest(length(a.t),length(b.t)) AS score FROM w JOIN nt a ON a.id=w.text_id JOIN nb b ON b.id=w.box_id WHERE w.rk>0 AND box_id IS NOT NULL)"""


def scanned(t):
    k = F.col("id")
    return t.annotations.select("id", "project_id", (F.col("x") + k % 7).alias("x"), (F.col("y") + k % 5).alias("y"),
                                F.when(k % 4 == 0, F.replace("text", F.lit("0"), F.lit("O"))).when(k % 4 == 1, F.lower("text"))
                                .otherwise(F.concat("text", F.lit("."))).alias("text"))


@query("anchor_texts", "D3 D14 C12", ANCH + " SELECT * FROM matches")
def _(t):
    return D.anchor_texts(t.annotations, scanned(t), 0.5, 60.0)


@query("anchor_stats", "D14 U3", ANCH + """, s AS (SELECT a.project_id, count(*) AS anchored, avg(sqrt((a.x-b.x)^2+(a.y-b.y)^2)) AS mean_offset FROM matches m JOIN annotations a ON a.id=m.text_id JOIN bx b ON b.id=m.box_id GROUP BY 1),
n AS (SELECT project_id, count(*) AS n FROM annotations GROUP BY 1)
SELECT n.project_id, n.n AS texts, n.n AS boxes, coalesce(anchored,0) AS anchored, mean_offset, coalesce(anchored,0)/n.n AS rate, n.n-coalesce(anchored,0) AS unmatched_texts, n.n-coalesce(anchored,0) AS unmatched_boxes FROM n LEFT JOIN s USING (project_id)""")
def _(t):
    return D.anchor_stats(t.annotations, scanned(t), D.anchor_texts(t.annotations, scanned(t), 0.5, 60.0))


# -- cleaning -------------------------------------------------------------------------------------------------

def entities(t):
    s = t.segments.select("id", "project_id", F.lit("line").alias("kind"), "x1", "y1", "x2", "y2", "confidence", F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    k = F.col("id")
    arc = t.annotations.select((k + 1000000000).alias("id"), "project_id", F.lit("arc").alias("kind"), (k % 360).cast("double").alias("start_angle"),
                               (k * 7 % 360).cast("double").alias("end_angle"), F.lit(0.9).alias("confidence"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    c = t.symbols.select((k + 2000000000).alias("id"), "project_id", F.lit("circle").alias("kind"), F.col("x").alias("cx"), F.col("y").alias("cy"),
                         (k % 12).cast("double").alias("radius"), F.lit(0.9).alias("confidence"), F.lit(200.0).alias("width"), F.lit(200.0).alias("height"))
    return s.unionByName(arc, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


def boxes(t):
    return C.text_boxes(t.annotations.withColumn("height", F.lit(10)))


CLEAN = ctes("segments", "annotations", "symbols") + """, tb AS (SELECT project_id, x-3 AS bx0, y-7-3 AS by0, x+greatest(20, length(text)*8)+3 AS bx1, y+7+3 AS by1 FROM annotations),
hit AS (SELECT DISTINCT s.id FROM segments s JOIN tb ON tb.project_id=s.project_id WHERE sqrt((x2-x1)^2+(y2-y1)^2)>=10 AND CASE WHEN x2>x1 THEN y1 BETWEEN by0 AND by1 AND least(1e0,(bx1-x1)/(x2-x1))-greatest(0e0,(bx0-x1)/(x2-x1))>0.3e0
 ELSE x1 BETWEEN bx0 AND bx1 AND least(1e0,(by1-y1)/(y2-y1))-greatest(0e0,(by0-y1)/(y2-y1))>0.3e0 END),
sp AS (SELECT id+1000000000 AS id, CASE WHEN abs(id*7%360-id%360)>180 THEN 360-abs(id*7%360-id%360) ELSE abs(id*7%360-id%360) END AS span FROM annotations),
r AS (SELECT s.id, 'line' AS kind, CASE WHEN sqrt((x2-x1)^2+(y2-y1)^2)<10 THEN 'short_segment' WHEN s.id IN (SELECT id FROM hit) THEN 'through_text' WHEN confidence<0.3 THEN 'low_confidence'
 WHEN (x1<5 OR x1>195 OR y1<5 OR y1>195) AND (x2<5 OR x2>195 OR y2<5 OR y2>195) THEN 'edge_artifact' END AS reason FROM segments s
 UNION ALL SELECT id, 'arc', CASE WHEN span<15 THEN 'short_segment' WHEN span<54 THEN 'incomplete_curve' END FROM sp
 UNION ALL SELECT id+2000000000, 'circle', CASE WHEN x-id%12<5 OR x+id%12>195 OR y-id%12<5 OR y+id%12>195 THEN 'edge_artifact' WHEN id%12<=3 THEN 'tiny_circle' END FROM symbols)"""


@query("clean", "L1 L2 L3 L4 L5 L6 L7", CLEAN + " SELECT id, kind, reason FROM r")
def _(t):
    return C.clean(entities(t), boxes(t)).select("id", "kind", "reason")


@query("clean_stats", "L7", CLEAN + " SELECT coalesce(reason,'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def _(t):
    return C.clean_stats(C.clean(entities(t), boxes(t)))


TILT = "tl AS (SELECT id, project_id, x1, y1, x1+40*cos(radians((id%400)*0.9)) AS x2, y1+40*sin(radians((id%400)*0.9)) AS y2, (id%400)*0.9 AS deg FROM segments)"


def tilted(t):
    a = F.radians((F.col("id") % 400) * 0.9)
    return t.segments.select("id", "project_id", "x1", "y1", (F.col("x1") + 40 * F.cos(a)).alias("x2"), (F.col("y1") + 40 * F.sin(a)).alias("y2"))


@query("snap_orthogonal", "L8", ctes("segments") + f""", {TILT}, q AS (SELECT *, round(deg/90) AS n FROM tl) SELECT id, CASE WHEN abs(deg-n*90)<=2 THEN x1+40*CASE n%4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END ELSE x2 END AS x2,
 CASE WHEN abs(deg-n*90)<=2 THEN y1+40*CASE n%4 WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END ELSE y2 END AS y2 FROM q""")
def _(t):
    return C.snap_orthogonal(tilted(t)).select("id", "x2", "y2")


@query("align_cardinal", "L9", ctes("segments") + f""", {TILT}, q AS (SELECT *, round((deg%180)/45)*45 AS c FROM tl) SELECT id, CASE WHEN abs(deg%180-c) BETWEEN 0.01 AND 2 THEN x1+40*cos(radians(c)) ELSE x2 END AS x2,
 CASE WHEN abs(deg%180-c) BETWEEN 0.01 AND 2 THEN y1+40*sin(radians(c)) ELSE y2 END AS y2 FROM q""")
def _(t):
    return C.align_cardinal(tilted(t)).select("id", "x2", "y2")


@query("snap_grid", "L10", ctes("elements") + """ SELECT id, CASE WHEN abs(x-round_even(x/5,0)*5)<=0.8 THEN round_even(x/5,0)*5 ELSE x END AS x, CASE WHEN abs(y-round_even(y/5,0)*5)<=0.8 THEN round_even(y/5,0)*5 ELSE y END AS y FROM elements""")
def _(t):
    return C.snap_grid(t.elements.select("id", "x", "y"), ["x", "y"], 5.0, 0.8)


EP = "ep AS (SELECT id, project_id, 0 AS e, x1 AS x, y1 AS y FROM segments UNION ALL SELECT id, project_id, 1, x2, y2 FROM segments)"


@query("connect_endpoints", "L11", ctes("segments") + f""", {EP}, d AS (SELECT a.id, a.e, (a.x+b.x)/2 AS nx, (a.y+b.y)/2 AS ny, row_number() OVER (PARTITION BY a.id, a.e ORDER BY sqrt((a.x-b.x)^2+(a.y-b.y)^2), b.x, b.y) AS rn
 FROM ep a JOIN ep b ON a.project_id=b.project_id AND a.id<>b.id AND sqrt((a.x-b.x)^2+(a.y-b.y)^2)<=4 AND (a.x<>b.x OR a.y<>b.y)), n AS (SELECT * FROM d WHERE rn=1)
SELECT s.id, coalesce(p.nx,s.x1) AS x1, coalesce(p.ny,s.y1) AS y1, coalesce(q.nx,s.x2) AS x2, coalesce(q.ny,s.y2) AS y2 FROM segments s LEFT JOIN n p ON p.id=s.id AND p.e=0 LEFT JOIN n q ON q.id=s.id AND q.e=1""")
def _(t):
    return C.connect_endpoints(t.segments, 4.0).select("id", "x1", "y1", "x2", "y2")


@query("snap_to_junctions", "L12", ctes("segments", "symbols") + f""", {EP}, d AS (SELECT a.id, a.e, s.x AS nx, s.y AS ny, row_number() OVER (PARTITION BY a.id, a.e ORDER BY sqrt((a.x-s.x)^2+(a.y-s.y)^2), s.id) AS rn
 FROM ep a JOIN symbols s ON s.project_id=a.project_id AND sqrt((a.x-s.x)^2+(a.y-s.y)^2)<8), n AS (SELECT * FROM d WHERE rn=1)
SELECT s.id, coalesce(p.nx,s.x1) AS x1, coalesce(p.ny,s.y1) AS y1, coalesce(q.nx,s.x2) AS x2, coalesce(q.ny,s.y2) AS y2 FROM segments s LEFT JOIN n p ON p.id=s.id AND p.e=0 LEFT JOIN n q ON q.id=s.id AND q.e=1""")
def _(t):
    return C.snap_to_junctions(t.segments, t.symbols, 8.0).select("id", "x1", "y1", "x2", "y2")


COL = "tr AS (SELECT id, project_id, y2>y1 AS vert, CASE WHEN y2>y1 THEN x1 ELSE y1 END AS track, CASE WHEN y2>y1 THEN y1 ELSE x1 END AS lo, CASE WHEN y2>y1 THEN y2 ELSE x2 END AS hi FROM segments)"


@query("merge_collinear", "L13", SEG + f", {COL}, " + oracle.clusters("tr", "id", "k.vert=u.vert AND abs(k.track-u.track)<=5 AND greatest(u.lo-k.hi, k.lo-u.hi)<=20") + """,
mm AS (SELECT cl.seed, s.track AS st, s.vert AS sv, t.lo, t.hi, t.id FROM cl JOIN tr t ON t.id=cl.id JOIN tr s ON s.id=cl.seed),
gp AS (SELECT seed, lo-lag(hi) OVER (PARTITION BY seed ORDER BY lo, hi, id) AS gap FROM mm), gs AS (SELECT seed, count(*) AS n, avg(gap) AS a, min(gap) AS mi, max(gap) AS ma FROM gp WHERE gap>=2 GROUP BY seed)
SELECT mm.seed AS id, CASE WHEN any_value(sv) THEN any_value(st) ELSE min(lo) END AS x1, CASE WHEN any_value(sv) THEN min(lo) ELSE any_value(st) END AS y1, CASE WHEN any_value(sv) THEN any_value(st) ELSE max(hi) END AS x2,
 CASE WHEN any_value(sv) THEN max(hi) ELSE any_value(st) END AS y2, count(*) AS members, CASE WHEN any_value(n)>=2 AND any_value(greatest(ma-a,a-mi))<=0.3*any_value(a) THEN 'DASHED' ELSE 'CONTINUOUS' END AS linetype FROM mm LEFT JOIN gs ON gs.seed=mm.seed GROUP BY mm.seed""")
def _(t):
    return C.merge_collinear(t.segments).drop("project_id")


@query("refine", "L14")
def _(t):
    return C.refine(t.segments, t.symbols)[1]


@query("build_polylines", "L15")
def _(t):
    """Vertices of all polylines; the edges of an axis-parallel drawing are checked against a walk in the tests."""
    walk = C.build_polylines(t.segments, 1.0)
    return C.polyline_points(t.segments, walk)


@query("polyline_summary", "L15", ctes("segments", recursive=True) + """, ep AS (SELECT id, project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT id, project_id, x2, y2 FROM segments),
nd AS (SELECT project_id, x, y, min(id) AS a, max(id) AS b FROM ep GROUP BY ALL HAVING count(*)=2 AND min(id)<>max(id)), lk AS (SELECT a, b FROM nd UNION SELECT b, a FROM nd),
cc(id, label) AS (SELECT id, id FROM segments UNION SELECT lk.b, cc.label FROM cc JOIN lk ON lk.a=cc.id), lb AS (SELECT id, min(label) AS polyline_id FROM cc GROUP BY id)
SELECT polyline_id, count(*) AS n_lines, sum(sqrt((x2-x1)^2+(y2-y1)^2)) AS length FROM lb JOIN segments USING (id) GROUP BY polyline_id""")
def _(t):
    walk = C.build_polylines(t.segments, 1.0)
    return walk.join(t.segments, "id").groupBy("polyline_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(geom.length()).alias("length"))


@query("simplify_rdp", "L16", """WITH RECURSIVE p AS (SELECT user_id AS line, event_id AS seq, (event_id*37%100)::DOUBLE AS x, floor(value/50)*50 AS y FROM events),
e AS (SELECT line, min(seq) AS lo, max(seq) AS hi FROM p GROUP BY line),
iv(line, lo, hi) AS (SELECT line, lo, hi FROM e UNION ALL SELECT s.line, unnest([s.lo, s.mid]), unnest([s.mid, s.hi]) FROM (
 SELECT iv.line, iv.lo, iv.hi, arg_max(q.seq, (CASE WHEN hypot_len>0 THEN abs((q.y-a.y)*(b.x-a.x)-(q.x-a.x)*(b.y-a.y))/hypot_len ELSE sqrt((q.x-a.x)^2+(q.y-a.y)^2) END, -q.seq)) AS mid,
 max(CASE WHEN hypot_len>0 THEN abs((q.y-a.y)*(b.x-a.x)-(q.x-a.x)*(b.y-a.y))/hypot_len ELSE sqrt((q.x-a.x)^2+(q.y-a.y)^2) END) AS d
 FROM iv JOIN p a ON a.line=iv.line AND a.seq=iv.lo JOIN p b ON b.line=iv.line AND b.seq=iv.hi JOIN p q ON q.line=iv.line AND q.seq>iv.lo AND q.seq<iv.hi, LATERAL (SELECT sqrt((b.x-a.x)^2+(b.y-a.y)^2) AS hypot_len)
 GROUP BY iv.line, iv.lo, iv.hi) s WHERE s.d>30)
SELECT DISTINCT line, seq FROM (SELECT line, lo AS seq FROM iv UNION SELECT line, hi FROM iv)""")
def _(t):
    from planloom.plans.q_stats import points
    return C.simplify_rdp(points(t), ["line"], 30.0).select("line", "seq")
