"""Registered queries: element edges, rooms, lines and symbols."""

from pyspark.sql import functions as F

from planloom.operators import relations as R
from planloom.operators import stats
from planloom.plans.bind import ctes
from planloom.plans.registry import query
from planloom.staging import materialize


def live(t):
    return t.elements.where("not deleted")


PAIR_NEAR = """SELECT p.project_id, p.id AS from_id, q.id AS to_id, 'near' AS relation_type,
 sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z)) AS distance
 FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.id<>q.id
 WHERE NOT p.deleted AND NOT q.deleted
 AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)+(p.z-q.z)*(p.z-q.z))<=2"""
PAIR_BOX = """SELECT p.project_id, p.id AS from_id, q.id AS to_id, 'intersects' AS relation_type, CAST(NULL AS DOUBLE) AS distance
 FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.id<q.id
 WHERE NOT p.deleted AND NOT q.deleted AND p.min_x<=q.max_x AND p.max_x>=q.min_x AND p.min_y<=q.max_y AND p.max_y>=q.min_y"""
PAIR_LAYER = """SELECT p.project_id, p.id AS from_id, q.id AS to_id, 'on_layer' AS relation_type, CAST(NULL AS DOUBLE) AS distance
 FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.layer=q.layer AND p.id<q.id
 JOIN (SELECT project_id, layer FROM elements WHERE NOT deleted GROUP BY project_id, layer HAVING count(*)<=100) c
 ON c.project_id=p.project_id AND c.layer=p.layer WHERE NOT p.deleted AND NOT q.deleted"""
ALL = f"({PAIR_NEAR}) UNION ALL ({PAIR_BOX}) UNION ALL ({PAIR_LAYER})"
RADIUS, LAYER_LIMIT = 2.0, 100


@query("relationship_stats", "J2 A1 J9", ctes("elements") + f""", e AS ({ALL})
SELECT coalesce(relation_type,'*') AS relation_type, count(*) AS n, avg(distance) AS avg_distance,
 min(distance) AS min_distance, max(distance) AS max_distance FROM e GROUP BY GROUPING SETS ((relation_type),())""")
def _(t):
    return stats.relationship_stats(R.all_edges(live(t), RADIUS, LAYER_LIMIT))


@query("intersecting_pairs", "J1", ctes("elements") + PAIR_BOX)
def _(t):
    return R.intersecting_pairs(live(t))


@query("within_distance", "J2", ctes("elements") + PAIR_NEAR)
def _(t):
    return R.within_distance(live(t), RADIUS)


@query("on_layer_pairs", "J5", ctes("elements") + PAIR_LAYER)
def _(t):
    return R.on_layer_pairs(live(t), LAYER_LIMIT)


@query("all_edges", "J9", ctes("elements") + ALL)
def _(t):
    return R.all_edges(live(t), RADIUS, LAYER_LIMIT)


@query("segment_intersections", "J1", ctes("segments") + """, s AS (SELECT *, least(x1,x2) a0, greatest(x1,x2) a1, least(y1,y2) b0, greatest(y1,y2) b1 FROM segments)
SELECT p.project_id, p.id AS id1, q.id AS id2 FROM s p JOIN s q ON p.project_id=q.project_id AND p.id<q.id
 AND p.a0<=q.a1 AND p.a1>=q.a0 AND p.b0<=q.b1 AND p.b1>=q.b0""")
def _(t):
    # every segment of the view is axis-parallel, for which box overlap and segment contact are the same
    return R.segment_intersections(t.segments).select(
        F.col("a.project_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"))


@query("recompute_edges", "J8", ctes("elements").replace("elements AS", "raw AS") + """,
elements AS (SELECT * REPLACE (CASE WHEN size BETWEEN 20 AND 27 THEN x+0.5 ELSE x END AS x, CASE WHEN size BETWEEN 20 AND 27 THEN min_x+0.5 ELSE min_x END AS min_x,
 CASE WHEN size BETWEEN 20 AND 27 THEN max_x+0.5 ELSE max_x END AS max_x) FROM raw)
""" + ALL)
def _(t):
    """Old edges of the unmoved drawing, updated after the elements of some sizes moved."""
    old = materialize(R.all_edges(live(t), RADIUS, LAYER_LIMIT))
    moved = F.col("size").between(20, 27)
    new = live(t)
    for c in ("x", "min_x", "max_x"):
        new = new.withColumn(c, F.when(moved, F.col(c) + 0.5).otherwise(F.col(c)))
    return R.recompute_edges(old, new, live(t).where(moved).select("id"), RADIUS, LAYER_LIMIT, before=live(t))


REF = "r AS (SELECT * FROM elements WHERE id = (SELECT min(id) FROM elements WHERE NOT deleted))"


def ref(t):
    return live(t).orderBy("id").limit(1)


@query("nearby_element", "J3", ctes("elements") + f""", {REF}
SELECT e.id, sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z)) AS distance FROM elements e, r
 WHERE NOT e.deleted AND e.project_id=r.project_id AND e.id<>r.id
 AND sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z))<=15 ORDER BY distance, id LIMIT 50""")
def _(t):
    return R.nearby(live(t), ref(t), 15.0).orderBy("distance", "id").limit(50).select("id", "distance")


@query("near_point", "J4", ctes("elements") + """
SELECT id, sqrt((x-50)*(x-50)+(y-50)*(y-50)+(z-2)*(z-2)) AS distance FROM elements WHERE NOT deleted AND entity_type='ECONOMY'
 AND sqrt((x-50)*(x-50)+(y-50)*(y-50)+(z-2)*(z-2))<=20 ORDER BY distance, id LIMIT 100""")
def _(t):
    return R.near_point(live(t), (50.0, 50.0, 2.0), 20.0, "ECONOMY").orderBy("distance", "id").limit(100).select("id", "distance")


@query("related_elements", "J6", ctes("elements") + f""", e AS ({ALL}), b AS (SELECT from_id AS id, to_id AS other FROM e WHERE relation_type IN ('near','intersects')
 UNION SELECT to_id, from_id FROM e WHERE relation_type IN ('near','intersects')) SELECT b.id, b.other FROM b JOIN elements x ON x.id=b.id WHERE x.entity_type='PROMO'""")
def _(t):
    ids = live(t).where("entity_type = 'PROMO'").select("id")
    return R.related(R.all_edges(live(t), RADIUS, LAYER_LIMIT), ids, ["near", "intersects"])


@query("intersecting_with", "J7", ctes("elements") + """, r AS (SELECT * FROM elements WHERE NOT deleted ORDER BY size DESC, id LIMIT 1)
SELECT e.id FROM elements e, r WHERE NOT e.deleted AND e.project_id=r.project_id AND e.id<>r.id
 AND e.min_x<=r.max_x AND e.max_x>=r.min_x AND e.min_y<=r.max_y AND e.max_y>=r.min_y""")
def _(t):
    return R.intersecting_with(live(t), live(t).orderBy(F.desc("size"), "id").limit(1)).select("id")


@query("hosted_edges", "J10", ctes("elements") + """, p AS (SELECT project_id, source_id AS h, 'S'||(id+7) AS d FROM elements WHERE NOT deleted)
SELECT p.project_id, a.id AS from_id, b.id AS to_id, 'hosts' AS relation_type FROM p
 JOIN elements a ON a.source_id=p.h AND a.project_id=p.project_id AND NOT a.deleted
 JOIN elements b ON b.source_id=p.d AND b.project_id=p.project_id AND NOT b.deleted""")
def _(t):
    pairs = live(t).select("project_id", F.col("source_id").alias("host_source"),
                           F.concat(F.lit("S"), F.col("id") + 7).alias("hosted_source"), F.lit("hosts").alias("relation_type"))
    return R.hosted_edges(pairs, live(t))


def boundaries(t):
    """Rooms as polygons with one cut corner."""
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    return t.rooms.select("id", "project_id", "name", F.array(
        pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0 + 10, y1), pt(x0, y0 + 30)).alias("boundary"))


# the oracle tests the cut corner as a half plane: (x0, y0+30)-(x0+10, y1) has slope 1
INSIDE = "s.x>r.x0 AND s.x<=r.x1 AND s.y>r.y0 AND s.y<=r.y1"


@query("contains_polygon", "J11", ctes("rooms", "symbols") + """, side AS (
 SELECT id, project_id, unnest([[x0,y0,x1,y0],[x1,y0,x1,y1],[x1,y1,x0+10,y1],[x0+10,y1,x0,y0+30],[x0,y0+30,x0,y0]]) AS p FROM rooms),
hit AS (SELECT r.project_id, r.id AS room_id, s.id AS symbol_id, s.kind FROM side r JOIN symbols s ON s.project_id=r.project_id
 WHERE s.y>least(p[2],p[4]) AND s.y<=greatest(p[2],p[4]) AND s.x<=greatest(p[1],p[3]) AND
 (p[1]=p[3] OR s.x<=(s.y-p[2])*(p[3]-p[1])/(p[4]-p[2])+p[1]) GROUP BY ALL HAVING count(*)%2=1)
SELECT project_id, 'contains' AS relation_type, room_id AS from_id, symbol_id AS to_id, 0.95e0 AS confidence FROM hit
UNION ALL SELECT project_id, 'serves', symbol_id, room_id, 0.9e0 FROM hit WHERE kind IN ('diffuser','outlet')""")
def _(t):
    return R.containment_edges(boundaries(t), t.symbols)


@query("contains_bbox", "J12", ctes("rooms", "symbols") + """
SELECT r.id AS room_id, s.id AS symbol_id FROM rooms r JOIN symbols s ON s.project_id=r.project_id
 WHERE s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1""")
def _(t):
    return R.contains_bbox(boundaries(t), t.symbols).select(F.col("room.id").alias("room_id"), F.col("point.id").alias("symbol_id"))


@query("rooms_adjacent", "J15", ctes("rooms") + """, side AS (
 SELECT id, project_id, unnest([[x0,y0,x1,y0],[x1,y0,x1,y1],[x1,y1,x0+10,y1],[x0+10,y1,x0,y0+30],[x0,y0+30,x0,y0]]) AS p FROM rooms),
u AS (SELECT *, sqrt((p[3]-p[1])^2+(p[4]-p[2])^2) AS l FROM side),
v AS (SELECT *, (p[3]-p[1])/l AS ux, (p[4]-p[2])/l AS uy FROM u),
j AS (SELECT a.project_id, a.id AS room1, b.id AS room2, abs(a.ux*b.uy-a.uy*b.ux) AS cr,
 abs((b.p[2]-a.p[2])*a.ux-(b.p[1]-a.p[1])*a.uy) AS off,
 a.p[1]*a.ux+a.p[2]*a.uy AS s0, a.p[3]*a.ux+a.p[4]*a.uy AS s1, b.p[1]*a.ux+b.p[2]*a.uy AS t0, b.p[3]*a.ux+b.p[4]*a.uy AS t1
 FROM v a JOIN v b ON a.project_id=b.project_id AND a.id<b.id)
SELECT DISTINCT project_id, room1, room2 FROM j WHERE cr<=0.1 AND off<=5 AND
 least(greatest(s0,s1),greatest(t0,t1))-greatest(least(s0,s1),least(t0,t1)) > 0.1*least(abs(s1-s0),abs(t1-t0))""")
def _(t):
    return R.rooms_adjacent(boundaries(t))


ENDS = "ends AS (SELECT id, project_id, 0 AS end_no, x1 AS x, y1 AS y FROM segments UNION ALL SELECT id, project_id, 1, x2, y2 FROM segments)"
LS = f"""{ENDS}, ls AS (SELECT e.project_id, e.id AS line_id, e.end_no, s.id AS symbol_id, sqrt((e.x-s.x)^2+(e.y-s.y)^2) AS distance
 FROM ends e JOIN symbols s ON s.project_id=e.project_id WHERE sqrt((e.x-s.x)^2+(e.y-s.y)^2)<15)"""


@query("line_symbol_edges", "J13", ctes("segments", "symbols") + f", {LS} SELECT *, greatest(0.5e0, 1-distance/15) AS confidence FROM ls")
def _(t):
    return R.line_symbol_edges(t.segments, t.symbols)


@query("symbol_symbol_edges", "J14 U2", ctes("segments", "symbols") + f""", {LS}
SELECT a.project_id, least(a.symbol_id,b.symbol_id) AS symbol1, greatest(a.symbol_id,b.symbol_id) AS symbol2, min(a.line_id) AS line_id,
 arg_min(sqrt((s.x2-s.x1)^2+(s.y2-s.y1)^2), a.line_id) AS length, 0.85e0 AS confidence
 FROM ls a JOIN ls b ON a.line_id=b.line_id AND a.end_no=0 AND b.end_no=1 AND a.symbol_id<>b.symbol_id JOIN segments s ON s.id=a.line_id GROUP BY 1,2,3""")
def _(t):
    return R.symbol_symbol_edges(t.segments, t.symbols)


@query("symbol_near", "J16", ctes("symbols") + """
SELECT a.project_id, a.id AS id1, b.id AS id2, sqrt((a.x-b.x)^2+(a.y-b.y)^2) AS distance, greatest(0.5e0, 1-sqrt((a.x-b.x)^2+(a.y-b.y)^2)/50) AS confidence
 FROM symbols a JOIN symbols b ON a.project_id=b.project_id AND a.id<b.id WHERE sqrt((a.x-b.x)^2+(a.y-b.y)^2)<50 AND sqrt((a.x-b.x)^2+(a.y-b.y)^2)>0""")
def _(t):
    return R.symbol_near(t.symbols)


@query("nearest_symbol", "J17", ctes("annotations", "symbols") + """
, p AS (SELECT a.project_id, a.id AS text_id, s.id AS symbol_id, sqrt((a.x-s.x)^2+(a.y-s.y)^2) AS distance,
 row_number() OVER (PARTITION BY a.id ORDER BY sqrt((a.x-s.x)^2+(a.y-s.y)^2), s.id) AS rn FROM annotations a JOIN symbols s ON a.project_id=s.project_id)
SELECT project_id, text_id, symbol_id, distance, greatest(0.5e0, 1-distance/50) AS confidence FROM p WHERE rn=1 AND distance<50""")
def _(t):
    return R.nearest_symbol(t.annotations, t.symbols)


@query("spacing_violations", "J23", ctes("elements") + """
SELECT p.project_id, p.id AS id1, q.id AS id2, sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS distance,
 1.5e0-sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y)) AS shortage FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.id<q.id
 WHERE NOT p.deleted AND NOT q.deleted AND sqrt((p.x-q.x)*(p.x-q.x)+(p.y-q.y)*(p.y-q.y))<1.5""")
def _(t):
    return R.spacing_violations(live(t), 1.5)


@query("clearance_around", "J24", ctes("elements") + f""", {REF}, d AS (
SELECT e.id, sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z)) AS distance FROM elements e, r
 WHERE NOT e.deleted AND e.project_id=r.project_id AND e.id<>r.id)
SELECT id, distance, distance<10 AS violation, CASE WHEN distance<10 THEN 10-distance END AS shortage FROM d WHERE distance<=15""")
def _(t):
    return R.clearance_around(live(t), ref(t), 10.0).select("id", "distance", "violation", "shortage")


@query("parallel_pairs", "J25", ctes("segments") + """, l AS (SELECT *, sqrt((x2-x1)^2+(y2-y1)^2) AS len, x2>x1 AS horizontal FROM segments)
SELECT a.project_id, a.id AS id1, b.id AS id2, CASE WHEN a.horizontal THEN abs(b.y1-a.y1) ELSE abs(b.x1-a.x1) END AS spacing,
 (a.len+b.len)/2 AS length, true AS is_orthogonal, (a.x1+b.x1)/2 AS cx1, (a.y1+b.y1)/2 AS cy1, (a.x2+b.x2)/2 AS cx2, (a.y2+b.y2)/2 AS cy2
 FROM l a JOIN l b ON a.project_id=b.project_id AND a.id<b.id AND a.horizontal=b.horizontal
 WHERE CASE WHEN a.horizontal THEN abs(b.y1-a.y1) ELSE abs(b.x1-a.x1) END BETWEEN 1 AND 72
 AND CASE WHEN a.horizontal THEN least(a.x2,b.x2)-greatest(a.x1,b.x1) ELSE least(a.y2,b.y2)-greatest(a.y1,b.y1) END > 0.3*least(a.len,b.len)""")
def _(t):
    # the view's lines are horizontal or vertical, which the oracle uses; the operator takes any angle
    return R.parallel_pairs(t.segments)
