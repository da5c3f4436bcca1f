"""Registered queries: graph jobs and geometry classification."""

from pyspark.sql import functions as F

from planloom.operators import classify as K
from planloom.operators import graph as G
from planloom.operators import topology as P
from planloom.plans import oracle
from planloom.plans.bind import ctes
from planloom.plans.registry import query

ARC = "arcs AS MATERIALIZED (SELECT a AS src, b AS dst FROM edges UNION SELECT b, a FROM edges)"
EDG = ctes("edges", recursive=True) + ", " + ARC
CC = "nd AS (SELECT DISTINCT src AS node FROM arcs), cc(node, component) USING KEY (node) AS (SELECT node, node FROM nd UNION (SELECT arcs.dst, min(cc.component) FROM cc JOIN arcs ON arcs.src=cc.node JOIN recurring.cc r ON r.node=arcs.dst WHERE cc.component<r.component GROUP BY arcs.dst))"


@query("adjacency", "G1", EDG + " SELECT src, dst FROM arcs")
def _(t):
    return G.adjacency(t.edges)


@query("components", "G6", EDG + f", {CC} SELECT node, component FROM cc")
def _(t):
    e = t.edges
    return G.components(e.select(F.explode(F.array("a", "b")).alias("node")).distinct(), e)


def bfs(start, depth):
    return f"d(node, hop) USING KEY (node) AS (SELECT node, 0 FROM ({start}) UNION (SELECT arcs.dst, min(d.hop)+1 FROM d JOIN arcs ON arcs.src=d.node LEFT JOIN recurring.d r ON r.node=arcs.dst WHERE r.node IS NULL AND d.hop<{depth} GROUP BY arcs.dst))"


KINDS = "('1-URGENT','2-HIGH','3-MEDIUM')"


def top(t):
    """The busiest end of the edges as the only seed."""
    from planloom.operators.stats import degree
    return degree(t.edges).orderBy(F.desc("degree"), "node").limit(1).select(F.lit(1).alias("seed"), "node")


TOP = "SELECT node FROM (SELECT node, count(*) AS n FROM (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) GROUP BY node ORDER BY n DESC, node LIMIT 1)"


@query("neighborhood_nodes", "G2 G3", ctes("edges", recursive=True) + f", arcs AS MATERIALIZED (SELECT a AS src, b AS dst FROM edges WHERE kind IN {KINDS} UNION SELECT b, a FROM edges WHERE kind IN {KINDS}), {bfs(TOP, 6)} SELECT node, hop FROM d")
def _(t):
    return P.neighborhood(t.edges, top(t), 6, ["1-URGENT", "2-HIGH", "3-MEDIUM"])[0].select("node", "hop")


@query("neighborhood_edges", "G2", EDG + f", {bfs(TOP, 4)} SELECT DISTINCT least(src,dst) AS a, greatest(src,dst) AS b FROM arcs JOIN d ON d.node=src WHERE d.hop<4")
def _(t):
    return P.neighborhood(t.edges, top(t), 4)[1].select("a", "b")


@query("trace_all", "G3", EDG + f", {bfs(TOP, 1 << 30)} SELECT node, hop FROM d")
def _(t):
    """Whole reach of the busiest node; the loop ends when no new node is found."""
    return G.levels(G.Arcs(G.adjacency(t.edges)), top(t), 1 << 30).select("node", "hop")


@query("shortest_path", "G4", EDG + f", {bfs(TOP, 40)} SELECT hop+1 AS n_nodes FROM d WHERE node=(SELECT max(b) FROM edges)")
def _(t):
    goal = t.edges.agg(F.max("b")).first()[0]
    return P.shortest_path(t.edges, top(t), goal, 41).select("n_nodes")


FAR = "(SELECT max(node) FROM d WHERE hop=2)"


@query("all_paths", "G5", EDG + f""", {bfs(TOP, 2)}, p(node, path) AS (SELECT node, [node] FROM ({TOP}) UNION ALL SELECT arcs.dst, list_append(p.path, arcs.dst) FROM p JOIN arcs ON arcs.src=p.node
 WHERE len(p.path)<7 AND NOT list_contains(p.path, arcs.dst) AND p.node<>{FAR}) SELECT array_to_string(path, '-') AS path FROM p WHERE node={FAR}""")
def _(t):
    """Simple paths of at most seven nodes from the busiest node to the largest node two hops away."""
    arcs = G.Arcs(G.adjacency(t.edges))
    near = G.levels(arcs, top(t), 2)
    start, goal = near.agg(F.max(F.when(F.col("hop") == 0, F.col("node"))), F.max(F.when(F.col("hop") == 2, F.col("node")))).first()
    return G.all_paths(arcs, start, goal, 7).select(F.array_join("path", "-").alias("path"))


def typed(t):
    """Graph nodes with a type: dear orders are sources, urgent ones terminals, the rest equipment."""
    kind = F.when(F.col("o_totalprice") > 497000, "source").when(F.col("o_orderpriority") == "1-URGENT", "terminal").otherwise("equipment")
    return t.orders.select(F.col("o_orderkey").alias("node"), kind.alias("node_type"))


TYPED = "ty AS (SELECT o_orderkey AS node, CASE WHEN o_totalprice>497000 THEN 'source' WHEN o_orderpriority='1-URGENT' THEN 'terminal' ELSE 'equipment' END AS node_type FROM orders)"
WALKS = """one AS (SELECT least(a,b) AS p, greatest(a,b) AS q, arg_min(length, id) AS length FROM edges WHERE a<>b GROUP BY ALL),
d(source, node, hop) USING KEY (source, node) AS (SELECT node, node, 0 FROM ty WHERE node_type='source' UNION (SELECT d.source, arcs.dst, min(d.hop)+1 FROM d JOIN arcs ON arcs.src=d.node LEFT JOIN recurring.d r ON r.source=d.source AND r.node=arcs.dst WHERE r.node IS NULL GROUP BY d.source, arcs.dst)),
up AS (SELECT d.source, d.node, min(p.node) AS parent FROM d JOIN arcs ON arcs.dst=d.node JOIN d p ON p.source=d.source AND p.node=arcs.src AND p.hop=d.hop-1 GROUP BY d.source, d.node),
w(source, terminal, node, hop, total_length, path) AS (SELECT source, node, node, hop, 0e0, [node] FROM d WHERE node IN (SELECT node FROM ty WHERE node_type='terminal')
 UNION ALL SELECT w.source, w.terminal, up.parent, w.hop, w.total_length+one.length, list_prepend(up.parent, w.path) FROM w JOIN up USING (source, node) JOIN one ON p=least(up.node,up.parent) AND q=greatest(up.node,up.parent)),
b AS (SELECT * FROM w WHERE node=source)"""


@query("system_paths", "G8", EDG + f", {TYPED}, {WALKS} SELECT source, terminal, hop::BIGINT AS hop, round(total_length,6) AS total_length, array_to_string(path,'-') AS path FROM b")
def _(t):
    n = typed(t)
    p = P.system_paths(t.edges, n.where("node_type = 'source'"), n.where("node_type = 'terminal'"))
    return p.withColumns({"path": F.array_join("path", "-"), "hop": F.col("hop").cast("long"), "total_length": F.round("total_length", 6)})


@query("feeds_edges", "G9", EDG + f", {TYPED}, {WALKS} SELECT source AS from_id, terminal AS to_id, 'feeds' AS relation_type, hop::BIGINT+1 AS n_nodes, 0.85e0 AS confidence FROM b WHERE hop>0")
def _(t):
    n = typed(t)
    f = P.feeds_edges(P.system_paths(t.edges, n.where("node_type = 'source'"), n.where("node_type = 'terminal'")))
    return f.withColumn("n_nodes", F.col("n_nodes").cast("long"))


@query("branch_edges", "G9", ctes("edges") + """, x AS (SELECT id, a AS node, b AS other, length FROM edges UNION ALL SELECT id, b, a, length FROM edges),
m AS (SELECT node, arg_max(id, (length, -id)) AS mid, arg_max(other, (length, -id)) AS main FROM x GROUP BY node HAVING count(*)=3) SELECT m.node AS tee, x.other AS from_id, m.main AS to_id, 0.75e0 AS confidence FROM m JOIN x USING (node) WHERE x.id<>m.mid""")
def _(t):
    return P.branch_edges(t.edges)


@query("branches", "G10", EDG + f""", dg AS (SELECT src, count(*) AS deg FROM arcs GROUP BY src), rt AS ({TOP}), {bfs('SELECT node FROM rt', 1 << 30)},
par AS (SELECT d.node, d.hop, min(p.node) AS parent FROM d JOIN arcs ON arcs.dst=d.node JOIN d p ON p.node=arcs.src AND p.hop=d.hop-1 GROUP BY d.node, d.hop),
t(node, hop, branch, level) AS (SELECT node, 0, node, 0 FROM rt UNION ALL SELECT par.node, par.hop, CASE WHEN dg.deg>=3 AND par.hop>1 THEN par.node ELSE t.branch END, CASE WHEN dg.deg>=3 AND par.hop>1 THEN t.level+1 ELSE t.level END FROM t JOIN par ON par.parent=t.node JOIN dg ON dg.src=t.node)
SELECT node, hop, branch, level FROM t""")
def _(t):
    return P.branches(t.edges, top(t).select("node"), 1 << 30).select("node", "hop", "branch", "level")


ALLN = "an AS (SELECT * FROM ty), dg AS (SELECT an.node, node_type, count(e.node) AS degree FROM an LEFT JOIN (SELECT a AS node FROM edges UNION ALL SELECT b FROM edges) e ON e.node=an.node GROUP BY ALL)"
CCALL = "cc(node, component) USING KEY (node) AS (SELECT node, node FROM (SELECT node FROM ty UNION SELECT src FROM arcs) UNION (SELECT arcs.dst, min(cc.component) FROM cc JOIN arcs ON arcs.src=cc.node JOIN recurring.cc r ON r.node=arcs.dst WHERE cc.component<r.component GROUP BY arcs.dst))"
CONN = f"""{TYPED}, {ALLN}, {CCALL}, z AS (SELECT component, count(*) AS size FROM cc GROUP BY component),
con AS (SELECT count(*) AS n_nodes, count(*) FILTER (WHERE degree=0) AS isolated, count(*) FILTER (WHERE degree=1 AND node_type='equipment') AS dead_ends, sum(degree)/count(*) AS mean_degree,
 (SELECT count(*) FROM z) AS n_components, (SELECT max(size) FROM z) AS largest_component, (SELECT count(*)=1 FROM z) AS connected FROM dg)"""


@query("connectivity", "G11", EDG + f", {CONN} SELECT * FROM con")
def _(t):
    return P.connectivity(typed(t), t.edges)


@query("graph_stats", "A8", EDG + f", {CONN} SELECT 'type:'||node_type AS name, count(*)::DOUBLE AS value FROM ty GROUP BY node_type UNION ALL SELECT 'n_nodes', n_nodes FROM con UNION ALL SELECT 'n_components', n_components FROM con UNION ALL SELECT 'mean_degree', mean_degree FROM con UNION ALL SELECT 'n_edges', count(*) FROM edges")
def _(t):
    return P.graph_stats(typed(t), t.edges)


@query("connected_equipment", "G12", EDG + f", {TYPED}, {bfs(TOP, 5)} SELECT d.node, node_type, hop FROM d JOIN ty ON ty.node=d.node WHERE hop>0")
def _(t):
    return P.connected_equipment(t.edges, typed(t), top(t), 5).select("node", "node_type", "hop")


@query("graph_nodes", "G7", ctes("segments", "symbols") + """, ep AS (SELECT project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT project_id, x2, y2 FROM segments)
SELECT 'J:'||project_id||':'||x::BIGINT||':'||y::BIGINT AS node, CASE WHEN count(*)>=4 THEN 'cross' WHEN count(*)=3 THEN 'tee' ELSE 'junction' END AS node_type FROM ep GROUP BY project_id, x, y
UNION ALL SELECT 'S:'||id, CASE kind WHEN 'valve' THEN 'valve' WHEN 'diffuser' THEN 'terminal' WHEN 'outlet' THEN 'terminal' WHEN 'ahu' THEN 'source' WHEN 'panel' THEN 'source' ELSE 'unknown' END FROM symbols""")
def _(t):
    return P.build_graph(t.segments, t.symbols)[0].select("node", "node_type")


@query("graph_edges", "G7", ctes("segments", "symbols") + """, ep AS (SELECT DISTINCT project_id, x, y FROM (SELECT project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT project_id, x2, y2 FROM segments)),
j AS (SELECT *, 'J:'||project_id||':'||x::BIGINT||':'||y::BIGINT AS node FROM ep), n AS (SELECT 'S:'||s.id AS a, j.node AS b, sqrt((s.x-j.x)^2+(s.y-j.y)^2) AS length, row_number() OVER (PARTITION BY s.id ORDER BY sqrt((s.x-j.x)^2+(s.y-j.y)^2), j.node) AS rn FROM symbols s JOIN j ON j.project_id=s.project_id WHERE sqrt((s.x-j.x)^2+(s.y-j.y)^2)<30)
SELECT 'J:'||project_id||':'||x1::BIGINT||':'||y1::BIGINT AS a, 'J:'||project_id||':'||x2::BIGINT||':'||y2::BIGINT AS b, 'run' AS edge_type, sqrt((x2-x1)^2+(y2-y1)^2) AS length FROM segments
UNION ALL SELECT a, b, 'connects_to', length FROM n WHERE rn=1""")
def _(t):
    return P.build_graph(t.segments, t.symbols)[1].drop("line_id")


@query("graph_with_rooms", "G7", ctes("segments", "symbols", "rooms") + """, s AS (SELECT *, CASE id%3 WHEN 0 THEN 'hvac' WHEN 1 THEN 'plumbing' END AS system FROM segments),
ep AS (SELECT DISTINCT project_id, x, y FROM (SELECT project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT project_id, x2, y2 FROM segments)),
n AS (SELECT project_id, x, y, 'J:'||project_id||':'||x::BIGINT||':'||y::BIGINT AS node FROM ep UNION ALL SELECT project_id, x, y, 'S:'||id FROM symbols)
SELECT 'J:'||project_id||':'||x1::BIGINT||':'||y1::BIGINT AS a, 'J:'||project_id||':'||x2::BIGINT||':'||y2::BIGINT AS b, 'run' AS edge_type, system FROM s WHERE id%5>1
UNION ALL SELECT 'R:'||r.id, n.node, 'contains', NULL FROM rooms r JOIN n ON n.project_id=r.project_id AND n.x BETWEEN r.x0 AND r.x1 AND n.y BETWEEN r.y0 AND r.y1""")
def _(t):
    """Runs by system without dimension lines and leaders, and what rooms contain."""
    kind = F.when(F.col("id") % 5 == 0, "dimension_line").when(F.col("id") % 5 == 1, "leader").otherwise("duct")
    lines = t.segments.withColumns({"system": F.when(F.col("id") % 3 == 0, "hvac").when(F.col("id") % 3 == 1, "plumbing"), "geometry_type": kind})
    rooms = t.rooms.withColumnsRenamed({"x0": "min_x", "y0": "min_y", "x1": "max_x", "y1": "max_y"})
    edges = P.build_graph(lines, t.symbols, rooms=rooms)[1]
    return edges.where("edge_type <> 'connects_to'").select("a", "b", "edge_type", "system")


EPS = "ep AS (SELECT id*2 AS id, project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT id*2+1, project_id, x2, y2 FROM segments)"
SG = ctes("segments", recursive=True) + f", {EPS}, " + oracle.greedy("ep", "id", "sqrt((k.x-u.x)^2+(k.y-u.y)^2)<9") + """,
nr AS (SELECT p.id, e.id AS node, row_number() OVER (PARTITION BY p.id ORDER BY sqrt((p.x-e.x)^2+(p.y-e.y)^2), e.id) AS rn FROM ep p JOIN kept k ON k.project_id=p.project_id AND k.id<=p.id JOIN ep e ON e.id=k.id WHERE sqrt((p.x-e.x)^2+(p.y-e.y)^2)<9),
sg AS MATERIALIZED (SELECT s.id, s.project_id, a.node AS a, b.node AS b FROM segments s JOIN nr a ON a.id=s.id*2 AND a.rn=1 JOIN nr b ON b.id=s.id*2+1 AND b.rn=1 WHERE a.node<>b.node)"""


@query("segment_graph", "G13", SG + " SELECT id, a, b FROM sg")
def _(t):
    return P.segment_graph(t.segments, 9.0)[1].select("id", "a", "b")


@query("dangling_ends", "G13", SG + """, ar AS (SELECT a AS src, b AS dst FROM sg UNION SELECT b, a FROM sg), o AS (SELECT src AS node, min(dst) AS nb FROM ar GROUP BY src HAVING count(*)=1),
d AS (SELECT o.node, k.id AS target, sqrt((p.x-e.x)^2+(p.y-e.y)^2) AS distance, row_number() OVER (PARTITION BY o.node ORDER BY sqrt((p.x-e.x)^2+(p.y-e.y)^2), k.id) AS rn FROM o JOIN ep p ON p.id=o.node JOIN kept k ON k.project_id=p.project_id AND k.id<>o.node AND k.id<>o.nb JOIN ep e ON e.id=k.id WHERE sqrt((p.x-e.x)^2+(p.y-e.y)^2)<12)
SELECT node, target, distance FROM d WHERE rn=1""".replace("o AS (SELECT src", "one AS (SELECT src").replace("SELECT o.node, k.id", "SELECT one.node, k.id").replace("BY o.node", "BY one.node").replace("FROM o JOIN ep p ON p.id=o.node", "FROM one JOIN ep p ON p.id=one.node").replace("k.id<>o.node AND k.id<>o.nb", "k.id<>one.node AND k.id<>one.nb"))
def _(t):
    nodes, edges = P.segment_graph(t.segments, 9.0)
    return P.dangling(nodes, edges, 12.0)


@query("collapse_degree2", "G13", SG + """, bo AS (SELECT id, a AS node, b AS nb FROM sg UNION ALL SELECT id, b, a FROM sg), tw AS (SELECT node, min(id) AS e1, max(id) AS e2, arg_min(nb,(id,nb)) AS n1, arg_max(nb,(id,nb)) AS n2 FROM bo GROUP BY node HAVING count(*)=2),
an AS (SELECT tw.*, degrees(acos(greatest(-1,least(1,((p.x-e.x)*(q.x-e.x)+(p.y-e.y)*(q.y-e.y))/(sqrt((p.x-e.x)^2+(p.y-e.y)^2)*sqrt((q.x-e.x)^2+(q.y-e.y)^2)))))) AS ang FROM tw JOIN ep e ON e.id=tw.node JOIN ep p ON p.id=n1 JOIN ep q ON q.id=n2 WHERE n1<>n2),
lk AS (SELECT e1 AS u, e2 AS v FROM an WHERE ang>=160 UNION SELECT e2, e1 FROM an WHERE ang>=160), cc(id, chain) AS (SELECT id, id FROM sg UNION SELECT lk.v, cc.chain FROM cc JOIN lk ON lk.u=cc.id) SELECT id, min(chain) AS chain FROM cc GROUP BY id""")
def _(t):
    nodes, edges = P.segment_graph(t.segments, 9.0)
    return P.collapse_degree2(nodes, edges)


# -- classification ---------------------------------------------------------------------------------------------

@query("class_by_linetype", "T1", ctes("segments") + " SELECT id, CASE linetype WHEN 'DASHED' THEN 'hidden' WHEN 'CENTER' THEN 'centerline' WHEN 'PHANTOM' THEN 'property' ELSE 'unknown' END AS geometry_type, CASE linetype WHEN 'DASHED' THEN 0.9e0 WHEN 'CENTER' THEN 0.9e0 WHEN 'PHANTOM' THEN 0.7e0 ELSE 0.5e0 END AS cls_confidence FROM segments")
def _(t):
    return K.class_by_linetype(t.segments).select("id", "geometry_type", "cls_confidence")


def slanted(t):
    """Lines in 200 directions, so that only some have a parallel partner."""
    a = F.radians((F.col("id") % 400) * 0.9)
    return t.segments.select("id", "project_id", "x1", "y1", (F.col("x1") + 40 * F.cos(a)).alias("x2"), (F.col("y1") + 40 * F.sin(a)).alias("y2"), "linetype")


def class_sql(kind):
    text = "(SELECT *, CASE WHEN id%6=3 THEN '12''-0\"' WHEN id%6=5 THEN '3/4\"' ELSE text END AS tx FROM annotations)"
    walls = kind == "unknown"
    conduit = kind == "mep_plan"
    return ctes("segments", "symbols", "annotations") + f""", sl AS (SELECT id, project_id, x1, y1, x1+40*cos(radians((id%400)*0.9)) AS x2, y1+40*sin(radians((id%400)*0.9)) AS y2, linetype, (id%400)*0.9 AS ang FROM segments),
an AS {text}, bs AS (SELECT *, (x2-x1)/sqrt((x2-x1)^2+(y2-y1)^2) AS ux, (y2-y1)/sqrt((x2-x1)^2+(y2-y1)^2) AS uy, sqrt((x2-x1)^2+(y2-y1)^2) AS len, CASE linetype WHEN 'DASHED' THEN 'hidden' WHEN 'CENTER' THEN 'centerline' WHEN 'PHANTOM' THEN 'property' ELSE 'unknown' END AS gt FROM sl),
pr AS (SELECT a.id AS id1, b.id AS id2, abs(((b.y1+b.y2)/2-a.y1)*a.ux-((b.x1+b.x2)/2-a.x1)*a.uy) AS sp, a.ang, a.len, abs(a.ang-b.ang) AS df, (b.x1-a.x1)*a.ux+(b.y1-a.y1)*a.uy AS t1, (b.x2-a.x1)*a.ux+(b.y2-a.y1)*a.uy AS t2
 FROM bs a JOIN bs b ON a.project_id=b.project_id AND a.id<b.id AND a.gt NOT IN ('hidden','centerline') AND b.gt NOT IN ('hidden','centerline')),
pp AS (SELECT *, abs(ang%90)<5 OR abs(ang%90-90)<5 AS ortho FROM pr WHERE (df<=3 OR abs(df-180)<=3 OR df>=357) AND sp BETWEEN 1 AND 72 AND least(len,greatest(t1,t2))-greatest(0,least(t1,t2))>0.3*least(len,abs(t2-t1))),
wl AS (SELECT id, arg_max(sp,(id1,id2)) AS sp FROM (SELECT id1 AS id, id1, id2, sp FROM pp WHERE ortho AND sp BETWEEN 3 AND 12 UNION ALL SELECT id2, id1, id2, sp FROM pp WHERE ortho AND sp BETWEEN 3 AND 12) GROUP BY id),
du AS (SELECT id, arg_max(sp,(id1,id2)) AS sp FROM (SELECT id1 AS id, id1, id2, sp FROM pp WHERE ortho AND sp BETWEEN 4 AND 48 UNION ALL SELECT id2, id1, id2, sp FROM pp WHERE ortho AND sp BETWEEN 4 AND 48) GROUP BY id),
ed AS (SELECT id, project_id, 0 AS e, x1 AS x, y1 AS y FROM sl UNION ALL SELECT id, project_id, 1, x2, y2 FROM sl),
pi AS (SELECT id, count(DISTINCT e) AS n FROM (SELECT d.id, d.e FROM ed d JOIN symbols s ON s.project_id=d.project_id AND s.kind='valve' WHERE sqrt((d.x-s.x)^2+(d.y-s.y)^2)<10) GROUP BY id),
co AS (SELECT id, count(DISTINCT e) AS n FROM (SELECT d.id, d.e FROM ed d JOIN symbols s ON s.project_id=d.project_id AND s.category='electrical' WHERE sqrt((d.x-s.x)^2+(d.y-s.y)^2)<10) GROUP BY id),
pz AS (SELECT l.id, arg_min(a.tx, a.id) AS tx FROM sl l JOIN an a ON a.project_id=l.project_id AND a.id%6=5 WHERE sqrt(((l.x1+l.x2)/2-a.x)^2+((l.y1+l.y2)/2-a.y)^2)<50 GROUP BY l.id),
di AS (SELECT DISTINCT l.id FROM sl l JOIN an a ON a.project_id=l.project_id AND a.id%6=3 WHERE sqrt(((l.x1+l.x2)/2-a.x)^2+((l.y1+l.y2)/2-a.y)^2)<30),
le AS (SELECT DISTINCT d.id FROM ed d JOIN an a ON a.project_id=d.project_id WHERE sqrt((d.x-a.x)^2+(d.y-a.y)^2)<20 INTERSECT SELECT DISTINCT d.id FROM ed d JOIN symbols s ON s.project_id=d.project_id WHERE sqrt((d.x-s.x)^2+(d.y-s.y)^2)<30),
fin AS (SELECT b.id, CASE WHEN du.id IS NOT NULL THEN 'duct_rectangular' {"WHEN wl.id IS NOT NULL THEN 'wall'" if walls else ""} WHEN b.gt<>'unknown' THEN b.gt WHEN pi.id IS NOT NULL THEN 'pipe' {"WHEN co.id IS NOT NULL THEN 'conduit'" if conduit else ""} WHEN di.id IS NOT NULL THEN 'dimension' WHEN le.id IS NOT NULL THEN 'leader' ELSE 'unknown' END AS geometry_type,
 du.sp AS dsp, wl.sp AS wsp, pz.tx, pi.n AS pn, co.n AS cn FROM bs b LEFT JOIN du ON du.id=b.id LEFT JOIN wl ON wl.id=b.id LEFT JOIN pi ON pi.id=b.id LEFT JOIN co ON co.id=b.id LEFT JOIN pz ON pz.id=b.id LEFT JOIN di ON di.id=b.id LEFT JOIN le ON le.id=b.id),
res AS (SELECT id, geometry_type, CASE geometry_type WHEN 'duct_rectangular' THEN 'supply_air' WHEN 'conduit' THEN 'power' END AS system, CASE geometry_type WHEN 'duct_rectangular' THEN 0.8e0 WHEN 'wall' THEN 0.85e0 WHEN 'hidden' THEN 0.9e0 WHEN 'centerline' THEN 0.9e0 WHEN 'property' THEN 0.7e0
 WHEN 'pipe' THEN CASE WHEN pn=2 THEN 0.75e0 ELSE 0.6e0 END WHEN 'conduit' THEN CASE WHEN cn=2 THEN 0.7e0 ELSE 0.55e0 END WHEN 'dimension' THEN 0.85e0 WHEN 'leader' THEN 0.8e0 ELSE 0.5e0 END AS cls_confidence, CASE geometry_type WHEN 'pipe' THEN tx END AS pipe_size FROM fin)"""


def notes(t):
    k = F.col("id") % 6
    return t.annotations.withColumn("text", F.when(k == 3, "12'-0\"").when(k == 5, '3/4"').otherwise(F.col("text")))


@query("classify_lines", "T2 T3 T4 T6", class_sql("unknown") + " SELECT * FROM res")
def _(t):
    c = K.classify_lines(slanted(t), t.symbols, notes(t))
    return c.withColumn("pipe_size", F.when(F.col("geometry_type") == "pipe", F.col("size"))).drop("size")


@query("classification_stats", "A7 T3", class_sql("mep_plan") + " SELECT geometry_type, coalesce(system,'unknown') AS system, count(*) AS n FROM res GROUP BY ALL")
def _(t):
    c = K.classify_lines(slanted(t), t.symbols, notes(t), "mep_plan")
    return c.groupBy("geometry_type", F.coalesce("system", F.lit("unknown")).alias("system")).agg(F.count(F.lit(1)).alias("n"))


@query("class_polylines", "T5", ctes("segments", "symbols") + """, d AS (SELECT DISTINCT s.id FROM segments s JOIN symbols y ON y.project_id=s.project_id AND y.kind='door' WHERE s.id%7+1>=3 AND s.id%2=0 AND (sqrt((s.x1-y.x)^2+(s.y1-y.y)^2)<50 OR sqrt((s.x2-y.x)^2+(s.y2-y.y)^2)<50))
SELECT id, CASE WHEN id IN (SELECT id FROM d) THEN 'door_swing' WHEN id%3=0 AND id%7+1>=4 THEN 'room_boundary' ELSE 'unknown' END AS geometry_type, CASE WHEN id IN (SELECT id FROM d) THEN 0.85e0 WHEN id%3=0 AND id%7+1>=4 THEN 0.7e0 ELSE 0e0 END AS cls_confidence FROM segments""")
def _(t):
    k = F.col("id")
    p = t.segments.withColumns({"n_points": k % 7 + 1, "closed": k % 3 == 0, "has_bulge": k % 2 == 0})
    return K.class_polylines(p, t.symbols.where("kind = 'door'"), "floor_plan")


@query("class_circles", "T5", """SELECT p_partkey AS id, CASE WHEN p_size BETWEEN 10 AND 24 THEN 'duct_round' ELSE 'unknown' END AS geometry_type, CASE WHEN p_size<10 THEN 0.3e0 WHEN p_size<=24 THEN 0.65e0 ELSE 0e0 END AS cls_confidence, CASE WHEN p_size BETWEEN 10 AND 24 THEN (p_size*2)||'"' END AS size FROM part""")
def _(t):
    return K.class_circles(t.part.select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("radius")), "hvac_plan")


@query("junction_types", "T7", ctes("segments", "symbols") + """, ed AS (SELECT id, project_id, x1 AS x, y1 AS y FROM segments UNION ALL SELECT id, project_id, x2, y2 FROM segments),
h AS (SELECT DISTINCT s.id AS j, d.id AS l FROM symbols s JOIN ed d ON d.project_id=s.project_id WHERE sqrt((s.x-d.x)^2+(s.y-d.y)^2)<7),
g AS (SELECT h.j, h.l, CASE WHEN sqrt((l.x1-s.x)^2+(l.y1-s.y)^2)<sqrt((l.x2-s.x)^2+(l.y2-s.y)^2) THEN CASE WHEN l.y2>l.y1 THEN 90e0 ELSE 0e0 END ELSE CASE WHEN l.y2>l.y1 THEN 270e0 ELSE 180e0 END END AS a FROM h JOIN segments l ON l.id=h.l JOIN symbols s ON s.id=h.j),
q AS (SELECT j, count(*) AS n, max(a)-min(a) AS sp, list_sort(list(a)) AS ls FROM g GROUP BY j),
w AS (SELECT *, list_transform([[1,2],[1,3],[2,3]], lambda p: CASE WHEN abs(ls[p[1]]-ls[p[2]])>180 THEN 360-abs(ls[p[1]]-ls[p[2]]) ELSE abs(ls[p[1]]-ls[p[2]]) END) AS gp FROM q)
SELECT s.id AS junction_id, coalesce(n,0) AS n_lines, CASE WHEN coalesce(n,0)<=1 THEN 'endpoint' WHEN n=2 THEN CASE WHEN gp[1] BETWEEN 80 AND 100 THEN 'l_junction' WHEN gp[1]<30 THEN 'tangent' ELSE 'corner' END
 WHEN n=3 THEN CASE WHEN list_contains(gp,180e0) AND list_contains(gp,90e0) THEN 't_junction' ELSE 'y_junction' END WHEN n=4 THEN 'x_junction' ELSE 'complex' END AS junction_type,
 CASE WHEN n=2 THEN gp[1] WHEN n>=3 THEN sp END AS angle_spread FROM symbols s LEFT JOIN w ON w.j=s.id""")
def _(t):
    return P.junction_types(t.symbols, t.segments, 7.0)


COMP = "co AS (SELECT event_id AS id, user_id AS page, value AS area, (event_id%30)::DOUBLE AS elongation, (event_id%130)::DOUBLE AS height FROM events)"


@query("text_or_graphics", "T11", f"""WITH {COMP}, m AS (SELECT page, median(area) AS med FROM co GROUP BY page), c AS (SELECT co.*, area<med*0.5 AS small FROM co JOIN m USING (page))
SELECT page, id, CASE WHEN small AND elongation<10 AND height BETWEEN 5 AND 100 THEN 'text' WHEN NOT small AND elongation>20 THEN 'graphics' WHEN NOT small AND height>100 THEN 'graphics' WHEN NOT small THEN 'mixed' ELSE 'graphics' END AS component_type,
 CASE WHEN small AND elongation<10 AND height BETWEEN 5 AND 100 THEN 0.9e0 WHEN NOT small AND elongation>20 THEN 0.9e0 WHEN NOT small AND height>100 THEN 0.8e0 WHEN NOT small THEN NULL ELSE 0.6e0 END AS confidence FROM c""")
def _(t):
    k = F.col("event_id")
    c = t.events.select(k.alias("id"), F.col("user_id").alias("page"), F.col("value").alias("area"), (k % 30).cast("double").alias("elongation"), (k % 130).cast("double").alias("height"))
    return K.text_or_graphics(c)


TL = "tc AS (SELECT event_id AS id, user_id AS project_id, (event_id*37%400)::DOUBLE AS x, (event_id*53%300)::DOUBLE AS y, (event_id%5+4)::DOUBLE AS width, (event_id%9+6)::DOUBLE AS height FROM events), t2 AS (SELECT tc.*, w FROM tc JOIN (SELECT project_id, avg(width) AS w FROM tc GROUP BY 1) USING (project_id))"


@query("text_lines", "W4", f"WITH RECURSIVE {TL}, " + oracle.clusters("t2", "y, id", "abs(u.y+u.height-k.y-k.height)<k.height*0.5 AND greatest(0, greatest(u.x-k.x-k.width, k.x-u.x-u.width))<k.w*2.5") + " SELECT project_id AS page, id, seed AS line FROM cl")
def _(t):
    k = F.col("event_id")
    c = t.events.select(k.alias("id"), F.col("user_id").alias("page"), (k * 37 % 400).cast("double").alias("x"), (k * 53 % 300).cast("double").alias("y"),
                        (k % 5 + 4).cast("double").alias("width"), (k % 9 + 6).cast("double").alias("height"))
    return K.text_lines(c)
