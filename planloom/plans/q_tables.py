"""Registered queries: scans, sources, keyed tables, filters and set operations."""

from pyspark.sql import functions as F

from planloom.operators import filters as X
from planloom.operators import keyed as K
from planloom.operators import memory as M
from planloom.operators import relations as R
from planloom.plans.bind import ctes
from planloom.plans.registry import query
from planloom.sources import entities as S
from planloom.staging import Stage

E = ctes("elements")
NOW = "TIMESTAMP '2024-01-03 00:00:00'"


def now():
    return F.lit("2024-01-03 00:00:00").cast("timestamp")


# -- S ------------------------------------------------------------------------------------------------

@query("scan_live", "S1", E + "SELECT id, project_id, entity_type, layer FROM elements WHERE NOT deleted")
def _(t):
    return t.elements.where("not deleted").select("id", "project_id", "entity_type", "layer")


@query("read_entities", "S2", "SELECT p_partkey AS handle, p_brand AS layer, p_type AS entity_type FROM part WHERE p_brand IN ('Brand#2','Brand#17','Brand#5')")
def _(t):
    df = S.read_entities(t.spark, f"{t.sf_dir}/part.parquet").withColumnsRenamed(
        {"p_partkey": "handle", "p_brand": "layer", "p_type": "entity_type"})
    return df.where(F.col("layer").isin("Brand#2", "Brand#17", "Brand#5")).select("handle", "layer", "entity_type")


def raw_entities(t):
    """Every part as a raw JSON entity: lines, circles and building-model rows with mixed field spellings."""
    k, s = F.col("p_partkey"), F.col("p_size")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    line = F.to_json(F.struct(F.lit("LINE").alias("type"), pt(k % 100, s).alias("start"), pt(k % 100 + s, s).alias("end")))
    circle = F.to_json(F.struct(F.lit("CIRCLE").alias("type"), pt(k % 70, k % 30).alias("center"), s.cast("double").alias("radius")))
    body = F.when(k % 3 == 0, F.to_json(F.struct(F.concat(F.lit("H"), k).alias("handle"), F.lit("LINE").alias("entity_type"),
                                                 F.col("p_brand").alias("layer"), line.alias("geometry"),
                                                 F.col("p_name").alias("color")))) \
        .when(k % 3 == 1, F.to_json(F.struct(F.concat(F.lit("H"), k).alias("Handle"), F.lit("CIRCLE").alias("EntityType"),
                                             F.col("p_brand").alias("Layer"), circle.alias("Geometry")))) \
        .otherwise(F.to_json(F.struct(k.cast("string").alias("ElementId"), F.when(s % 2 == 0, "Walls").otherwise("Pipes").alias("Category"),
                                      line.alias("Location"))))
    return t.part.select((k % 5).alias("project_id"), F.when(k % 3 == 2, "revit").otherwise("autocad").alias("source"), body.alias("body"))


@query("to_elements", "S3 C1 T14", """SELECT p_partkey%5 AS project_id,
 CASE WHEN p_partkey%3=2 THEN p_partkey::VARCHAR ELSE 'H'||p_partkey END AS source_id,
 CASE p_partkey%3 WHEN 0 THEN 'LINE' WHEN 1 THEN 'CIRCLE' ELSE CASE WHEN p_size%2=0 THEN 'WALL' ELSE 'PIPES' END END AS entity_type,
 CASE WHEN p_partkey%3<2 THEN p_brand END AS layer,
 CASE WHEN p_partkey%3=1 THEN (p_partkey%70)::DOUBLE ELSE (p_partkey%100) + p_size/2e0 END AS x,
 CASE WHEN p_partkey%3=1 THEN (p_partkey%30)::DOUBLE ELSE p_size::DOUBLE END AS y,
 CASE WHEN p_partkey%3=1 THEN (p_partkey%70-p_size)::DOUBLE ELSE (p_partkey%100)::DOUBLE END AS min_x,
 CASE WHEN p_partkey%3=1 THEN (p_partkey%70+p_size)::DOUBLE ELSE (p_partkey%100+p_size)::DOUBLE END AS max_x,
 CASE WHEN p_partkey%3=0 THEN p_name END AS color FROM part""")
def _(t):
    return S.to_elements(raw_entities(t)).select("project_id", "source_id", "entity_type", "layer", "x", "y", "min_x", "max_x",
                                                 F.try_element_at("properties", F.lit("_color")).alias("color"))


def versions(t):
    """Element versions: the stored table and a later batch that changes the larger parts and adds rows."""
    base = t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("layer"), F.lit(1).alias("version"),
                         F.when(F.col("p_partkey") % 50 == 0, F.lit("2024-01-01").cast("timestamp")).alias("deleted_at"))
    batch = t.part.where("p_size > 15").select(
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") + 10000000).otherwise(F.col("p_partkey")).alias("id"),
        F.lower("p_brand").alias("layer"), F.lit(2).alias("version"), F.lit(None).cast("timestamp").alias("deleted_at"))
    return base, batch


VERS = """WITH base AS (SELECT p_partkey AS id, p_brand AS layer, 1 AS version, CASE WHEN p_partkey%50=0 THEN TIMESTAMP '2024-01-01' END AS deleted_at FROM part),
batch AS (SELECT CASE WHEN p_partkey%7=0 THEN p_partkey+10000000 ELSE p_partkey END AS id, lower(p_brand) AS layer, 2 AS version, CAST(NULL AS TIMESTAMP) AS deleted_at FROM part WHERE p_size>15)"""


@query("upsert_elements", "S4", VERS + """ SELECT id, layer, version, deleted_at FROM
 (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) rn FROM (SELECT * FROM base UNION ALL SELECT * FROM batch)) WHERE rn=1""")
def _(t):
    base, batch = versions(t)
    return K.upsert(base, batch, ["id"], clear={"deleted_at": None})


@query("upsert_edges", "S5", ctes("edges") + """, n AS (SELECT a, b, kind, length/2 AS distance FROM edges WHERE length>50)
SELECT a, b, kind, CASE WHEN max(src)=1 THEN arg_max(distance, (src, distance)) ELSE max(distance) END AS distance FROM
 (SELECT a,b,kind,length AS distance,0 AS src FROM edges UNION ALL SELECT a,b,kind,distance,1 FROM n) GROUP BY a,b,kind""")
def _(t):
    old = t.edges.select("a", "b", "kind", F.col("length").alias("distance"))
    new = t.edges.where("length > 50").select("a", "b", "kind", (F.col("length") / 2).alias("distance"))
    return K.upsert(old, new, ["a", "b", "kind"], version="distance")


@query("insert_ignore", "S6", VERS + " SELECT id, layer, version FROM base UNION ALL SELECT id, layer, version FROM batch WHERE id NOT IN (SELECT id FROM base)")
def _(t):
    base, batch = versions(t)
    return K.insert_ignore(base, batch, ["id"]).select("id", "layer", "version")


@query("soft_delete", "S7", VERS + " SELECT id, layer, CASE WHEN id IN (SELECT id FROM batch) THEN coalesce(deleted_at, TIMESTAMP '2024-01-03 00:00:00') ELSE deleted_at END AS deleted_at FROM base")
def _(t):
    base, batch = versions(t)
    return K.soft_delete(base, batch, "id", now()).select("id", "layer", "deleted_at")


@query("purge_project", "S8", E + """ SELECT 'element' AS what, count(*) AS n FROM elements WHERE project_id<>(SELECT min(project_id) FROM elements)
UNION ALL SELECT 'edge', count(*) FROM elements p JOIN elements q ON p.project_id=q.project_id AND p.id<q.id AND NOT p.deleted AND NOT q.deleted
 AND p.min_x<=q.max_x AND p.max_x>=q.min_x AND p.min_y<=q.max_y AND p.max_y>=q.min_y WHERE p.project_id<>(SELECT min(project_id) FROM elements)""")
def _(t):
    first = t.elements.groupBy().agg(F.min("project_id").alias("project_id"))
    kept, edges = K.purge(t.elements, R.intersecting_pairs(t.elements.where("not deleted")), first)
    return kept.agg(F.lit("element").alias("what"), F.count(F.lit(1)).alias("n")).unionByName(
        edges.agg(F.lit("edge").alias("what"), F.count(F.lit(1)).alias("n")))


@query("purge_stored", "S8", ctes("elements", "segments") + """SELECT 'elements' AS name, project_id, count(*) AS n FROM elements WHERE project_id%3<>1 GROUP BY project_id
UNION ALL SELECT 'segments', project_id, count(*) FROM segments WHERE project_id%3<>1 GROUP BY project_id""")
def _(t):
    """Every third project is removed from two stored tables, whose folders are then read again."""
    root = Stage(t.spark, "projects").root
    paths = {name: f"{root}/{name}" for name in ("elements", "segments")}
    for name, path in paths.items():
        K.store_by_project(getattr(t, name), path, 16)
    K.purge_stored(t.spark, list(paths.values()), t.segments.select("project_id").union(t.elements.select("project_id")).where("project_id % 3 = 1"), 16)
    counts = [t.spark.read.parquet(path).groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "project_id", "n") for name, path in paths.items()]
    return counts[0].unionByName(counts[1])


@query("changed_files", "S9 C19", """SELECT url AS path, md5(html) AS hash FROM pages p WHERE NOT EXISTS
 (SELECT 1 FROM pages s WHERE s.url=p.url AND md5(CASE WHEN s.page_id%3=0 THEN s.html||'x' ELSE s.html END)=md5(p.html))""")
def _(t):
    manifest = t.pages.select(F.col("url").alias("path"), F.md5("html").alias("hash"))
    seen = t.pages.select(F.col("url").alias("path"), F.md5(F.when(F.col("page_id") % 3 == 0, F.concat("html", F.lit("x")))
                                                           .otherwise(F.col("html"))).alias("hash"))
    return K.changed_files(manifest, seen)


@query("lookup_batch", "S10", """SELECT o.o_custkey*2 AS id, c.c_name AS name, c.c_custkey IS NOT NULL AS found
 FROM (SELECT DISTINCT o_custkey FROM orders) o LEFT JOIN customer c ON c.c_custkey=o.o_custkey*2""")
def _(t):
    ids = t.orders.select((F.col("o_custkey") * 2).alias("id")).distinct()
    return K.lookup_batch(ids, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")))


@query("staleness", "S11 C20", ctes("facts") + f""" SELECT project_id, epoch_us({NOW})/1e6 - epoch_us(max(created_at))/1e6 AS age_seconds,
 epoch_us({NOW})/1e6 - epoch_us(max(created_at))/1e6 > 172000 AS stale FROM facts GROUP BY project_id""")
def _(t):
    return K.staleness(t.facts, ["project_id"], "created_at", now(), 172000)


@query("upsert_dims", "S12", """WITH v AS (SELECT n_regionkey AS level, s_nationkey AS elevation, s_suppkey AS version FROM supplier JOIN nation ON n_nationkey=s_nationkey)
SELECT level, elevation, version FROM (SELECT *, row_number() OVER (PARTITION BY level, elevation ORDER BY version DESC) rn FROM v) WHERE rn=1""")
def _(t):
    v = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("level"), F.col("s_nationkey").alias("elevation"), F.col("s_suppkey").alias("version"))
    return K.latest(v, ["level", "elevation"], ["version"]).orderBy("level", "elevation")


LAB = """WITH l AS (SELECT 'img_'||(p_partkey//4) AS image, CASE p_partkey%3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split,
 (p_size%12)::INTEGER AS class_id, (p_partkey%100)/100e0 AS cx, (p_partkey%37)/100e0 AS cy, p_size/100e0 AS w, (p_partkey%11)/100e0 AS h FROM part WHERE p_partkey%13<>0)"""


def labels(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    split = F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test")
    text = F.concat_ws(" ", s % 12, (k % 100) / 100, (k % 37) / 100, s / 100, (k % 11) / 100)
    lines = t.part.select(F.concat(F.lit("/labels/"), split, F.lit("/img_"), F.floor(k / 4), F.lit(".txt")).alias("path"),
                          F.when(k % 13 == 0, F.lit("broken line")).otherwise(text).alias("value"))
    return S.parse_labels(lines)


@query("parse_labels", "S13", LAB + " SELECT * FROM l")
def _(t):
    return labels(t)


@query("label_stats", "A18", LAB + " SELECT coalesce(class_id,-1) AS class_id, coalesce(split,'*') AS split, count(*) AS n, avg(w) AS mean_w, avg(h) AS mean_h FROM l GROUP BY CUBE(class_id, split)")
def _(t):
    c = labels(t).cube("class_id", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("w").alias("mean_w"), F.avg("h").alias("mean_h"))
    return c.withColumns({"class_id": F.coalesce("class_id", F.lit(-1)), "split": F.coalesce("split", F.lit("*"))})


@query("split_dataset", "S14")
def _(t):
    return K.split_dataset(t.documents.select("doc_id"), "doc_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("flatten_standards", "S15", """SELECT c_mktsegment AS discipline, 'systems' AS section, 'sys_'||(c_custkey%7) AS name, f.field, f.value FROM customer,
 LATERAL (SELECT 'prefix' AS field, 'P'||c_nationkey AS value UNION ALL SELECT 'color', (c_custkey%9)::VARCHAR) f""")
def _(t):
    fields = F.create_map(F.lit("prefix"), F.concat(F.lit("P"), "c_nationkey"), F.lit("color"), (F.col("c_custkey") % 9).cast("string"))
    doc = F.to_json(F.create_map(F.lit("systems"), F.create_map(F.concat(F.lit("sys_"), F.col("c_custkey") % 7), fields)))
    return S.flatten_standards(t.customer.select(F.col("c_mktsegment").alias("discipline"), doc.alias("doc")))


@query("append_results", "S16", "SELECT status, count(*) AS n FROM (SELECT o_orderstatus AS status FROM orders UNION ALL SELECT l_linestatus FROM lineitem) GROUP BY status")
def _(t):
    from planloom.staging import Stage
    log = f"{Stage(t.spark, 'log').root}/results"
    for df in (t.orders.select(F.col("o_orderstatus").alias("status")), t.lineitem.select(F.col("l_linestatus").alias("status"))):
        df.write.mode("append").parquet(log)
    return t.spark.read.parquet(log).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("set_status", "S17", "SELECT o_orderkey AS id, CASE WHEN o_orderpriority='5-LOW' THEN 'accepted' ELSE o_orderstatus END AS status FROM orders")
def _(t):
    table = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return K.set_status(table, t.orders.where("o_orderpriority = '5-LOW'").select(F.col("o_orderkey").alias("id"), F.lit("accepted").alias("status")))


def corrections(t):
    e = t.part.select(F.concat(F.lit("h"), "p_partkey").alias("handle"), F.col("p_brand").alias("layer"), F.col("p_size").alias("size"))
    k = F.col("p_partkey")
    c = t.part.select(
        k.alias("correction_id"), F.when(k % 5 == 0, "add").when(k % 5 == 1, "remove").when(k % 5 == 2, "modify").otherwise("replace").alias("action"),
        F.when(k % 5 == 0, F.lit(None)).when(k % 11 == 0, F.concat(F.lit("missing"), k)).otherwise(F.concat(F.lit("h"), k)).alias("handle"),
        F.when(k % 5 != 1, F.lower("p_brand")).alias("layer"), F.when((k % 5 == 0) | (k % 5 >= 3), F.col("p_size") + 1).alias("size"))
    return K.apply_corrections(e, c)


CORR = """WITH e AS (SELECT 'h'||p_partkey AS handle, p_brand AS layer, p_size AS size FROM part),
c AS (SELECT p_partkey AS correction_id, CASE p_partkey%5 WHEN 0 THEN 'add' WHEN 1 THEN 'remove' WHEN 2 THEN 'modify' ELSE 'replace' END AS action,
 CASE WHEN p_partkey%5=0 THEN NULL WHEN p_partkey%11=0 THEN 'missing'||p_partkey ELSE 'h'||p_partkey END AS handle,
 CASE WHEN p_partkey%5<>1 THEN lower(p_brand) END AS layer, CASE WHEN p_partkey%5=0 OR p_partkey%5>=3 THEN p_size+1 END AS size FROM part)"""


@query("apply_corrections", "S18", CORR + """ SELECT e.handle, CASE WHEN m.handle IS NULL THEN e.layer ELSE coalesce(m.layer,e.layer) END AS layer, coalesce(m.size,e.size) AS size
 FROM e LEFT JOIN (SELECT * FROM c WHERE action='modify') m ON m.handle=e.handle WHERE e.handle NOT IN (SELECT handle FROM c WHERE action IN ('remove','replace') AND handle IS NOT NULL)
 UNION ALL SELECT 'c'||correction_id, layer, size FROM c WHERE action IN ('add','replace')""")
def _(t):
    return corrections(t)[0]


@query("correction_results", "S18 A15", CORR + """ SELECT action, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT ok) AS failure FROM
 (SELECT action, action IN ('add','replace') OR handle IN (SELECT handle FROM e) AS ok FROM c) GROUP BY action""")
def _(t):
    return corrections(t)[1].groupBy("action").agg(F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failure"))


# -- F ------------------------------------------------------------------------------------------------

@query("by_type", "F1", E + "SELECT id, layer FROM elements WHERE NOT deleted AND entity_type='PROMO' ORDER BY id LIMIT 100")
def _(t):
    return t.elements.where("not deleted and entity_type = 'PROMO'").orderBy("id").limit(100).select("id", "layer")


@query("by_layer", "F2", E + "SELECT id, entity_type FROM elements WHERE NOT deleted AND layer='Brand#7' ORDER BY id LIMIT 100")
def _(t):
    return t.elements.where("not deleted and layer = 'Brand#7'").orderBy("id").limit(100).select("id", "entity_type")


@query("in_bbox", "F3", E + "SELECT id, x, y FROM elements WHERE NOT deleted AND x BETWEEN 20 AND 60 AND y BETWEEN 10 AND 45")
def _(t):
    return X.in_bbox(t.elements.where("not deleted"), 20, 10, 60, 45).select("id", "x", "y")


@query("text_like", "F4", E + """SELECT id FROM elements WHERE NOT deleted AND (contains(lower(description),'ring') OR contains(lower(layer),'ring')
 OR contains(lower(category),'ring') OR contains(lower(family),'ring') OR contains(lower(entity_type),'ring'))""")
def _(t):
    return X.text_like(t.elements.where("not deleted"), "Ring", ["description", "layer", "category", "family", "entity_type"]).select("id")


@query("category_contains", "F5", E + "SELECT id FROM elements WHERE contains(upper(category),'WID') OR contains(upper(entity_type),'WID')")
def _(t):
    return X.category_contains(t.elements, "wid").select("id")


@query("resolve_reference", "F6", E + """, refs AS (SELECT DISTINCT CASE c_custkey%3 WHEN 0 THEN 'S'||c_custkey WHEN 1 THEN c_custkey::VARCHAR ELSE c_name END AS ref FROM customer),
c AS (SELECT ref, id, 1 AS step FROM refs JOIN elements ON source_id=ref UNION ALL SELECT ref, id, 3 FROM refs JOIN elements ON id=TRY_CAST(ref AS BIGINT) AND regexp_full_match(ref,'[0-9]+')
 UNION ALL SELECT ref, min(id), 4 FROM refs JOIN elements ON length(description)=length(ref)-8 GROUP BY ref)
SELECT ref, arg_min(id, step) AS id, min(step)::INTEGER AS step FROM (SELECT * FROM c UNION ALL SELECT ref, NULL, NULL FROM refs) GROUP BY ref""")
def _(t):
    k = F.col("c_custkey")
    refs = t.customer.select(F.when(k % 3 == 0, F.concat(F.lit("S"), k)).when(k % 3 == 1, k.cast("string")).otherwise(F.col("c_name")).alias("ref")).distinct()
    best = t.elements.groupBy(F.length("description").alias("n")).agg(F.min("id").alias("id"))
    hits = refs.withColumn("n", F.length("ref") - 8).join(best, "n").select("ref", "id", F.lit(0).alias("rank"))
    return X.resolve_reference(t.elements, refs, hits)


# the driver's brands and part names stand in for layers and categories here
TEST_DOMAINS = {"hvac": {"categories": ["ring"], "layers": ["brand#1"], "types": ["promo"]},
                "plumbing": {"categories": ["widget"], "layers": ["brand#2"], "types": ["economy"]}}
DOM = """CASE WHEN contains(lower(category),'ring') OR contains(lower(layer),'brand#1') OR lower(entity_type)='promo' THEN 'hvac'
 WHEN contains(lower(category),'widget') OR contains(lower(layer),'brand#2') OR lower(entity_type)='economy' THEN 'plumbing' END"""


@query("in_domain", "F7", E + "SELECT id FROM elements WHERE contains(lower(category),'widget') OR contains(lower(layer),'brand#2') OR lower(entity_type)='economy'")
def _(t):
    return X.in_domain(t.elements, "plumbing", TEST_DOMAINS).select("id")


@query("domain_summary", "A3", E + f""", d AS (SELECT *, {DOM} AS domain FROM elements WHERE NOT deleted AND contains(lower(level),'l2'))
SELECT 'domain' AS what, domain AS value, count(*) AS n FROM d WHERE domain IS NOT NULL GROUP BY domain
UNION ALL SELECT * FROM (SELECT 'type', entity_type, count(*) AS n FROM d GROUP BY entity_type ORDER BY n DESC, entity_type LIMIT 20)""")
def _(t):
    d = t.elements.where("not deleted and contains(lower(level), 'l2')").withColumn("domain", X.domain_of(TEST_DOMAINS))
    by = lambda what, c: d.where(F.col(c).isNotNull()).groupBy(F.lit(what).alias("what"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by("domain", "domain").unionByName(by("type", "entity_type").orderBy(F.desc("n"), "value").limit(20))


@query("clashes", "J22", E + f""", a AS (SELECT * FROM elements WHERE NOT deleted AND level='L1' AND {DOM}='hvac'), b AS (SELECT * FROM elements WHERE NOT deleted AND level='L1' AND {DOM}='plumbing')
SELECT a.project_id, a.id AS id1, b.id AS id2, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance,
 (a.x+b.x)/2 AS mid_x, (a.y+b.y)/2 AS mid_y, (a.z+b.z)/2 AS mid_z FROM a JOIN b ON a.project_id=b.project_id AND a.id<>b.id
 WHERE sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z))<5""")
def _(t):
    e = t.elements.where("not deleted and level = 'L1'").withColumn("domain", X.domain_of(TEST_DOMAINS))
    return R.clashes(e.where("domain = 'hvac'"), e.where("domain = 'plumbing'"), 5.0)


@query("live_facts", "F8", ctes("facts") + f"SELECT id, key, confidence FROM facts WHERE (expires_at IS NULL OR expires_at>{NOW}) AND fact_type='T1' AND confidence>=0.1")
def _(t):
    return K.live_facts(t.facts, now(), "T1", 0.1).select("id", "key", "confidence")


@query("facts_keyword", "F9", ctes("facts") + "SELECT id FROM facts WHERE contains(lower(key),'err') OR contains(lower(value),'7')")
def _(t):
    return M.facts_keyword(t.facts, "ERR").select("id").union(M.facts_keyword(t.facts, "7").select("id")).distinct()


@query("symbols_list", "F10", ctes("symbols") + "SELECT id, kind, category FROM symbols WHERE confidence>0 AND category='electrical'")
def _(t):
    return t.symbols.where("confidence > 0 and category = 'electrical'").orderBy("category", "id").select("id", "kind", "category")


@query("edges_by_type", "F11 U4", ctes("edges") + "SELECT id, a, b FROM edges WHERE kind IN ('5-LOW','1-URGENT')")
def _(t):
    return X.edges_of(t.edges.withColumnRenamed("kind", "relation_type"), ["5-LOW", "1-URGENT"]).select("id", "a", "b")


@query("edges_contains", "F11", ctes("rooms", "symbols") + """SELECT r.id AS from_id, s.id AS to_id FROM rooms r JOIN symbols s ON s.project_id=r.project_id
 WHERE s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 AND r.name LIKE '%ring%'""")
def _(t):
    """What rooms of one kind contain, among the edges of all rooms."""
    rooms = t.rooms.withColumns({"boundary": F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])})
    inside = R.contains_bbox(rooms, t.symbols).select(F.col("room.id").alias("from_id"), F.col("point.id").alias("to_id"), F.lit("contains").alias("relation_type"))
    others = t.edges.select(F.col("a").alias("from_id"), F.col("b").alias("to_id"), F.col("kind").alias("relation_type"))
    return X.edges_contains(inside.unionByName(others), t.rooms.where("name like '%ring%'")).select("from_id", "to_id")


@query("json_eq", "F12 C18", "SELECT event_id FROM events WHERE json_extract_string(props,'$.k')='69'")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k") == "69").select("event_id")


@query("critical_issues", "F13", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority='1-URGENT'")
def _(t):
    return t.orders.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))


@query("missing_embeddings", "F14", "SELECT d.doc_id FROM documents d LEFT JOIN embeddings e ON e.vec_id=d.doc_id WHERE e.embedding IS NULL")
def _(t):
    j = t.documents.select("doc_id").join(t.embeddings.withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return j.where("embedding is null").select("doc_id")


@query("project_by_key", "F15", "SELECT min(page_id) AS page_id, url FROM pages WHERE md5(url)=(SELECT min(md5(url)) FROM pages) GROUP BY url")
def _(t):
    h = t.pages.agg(F.min(F.md5("url"))).first()[0]
    return t.pages.where(F.md5("url") == h).groupBy("url").agg(F.min("page_id").alias("page_id"))


@query("entity_query", "F16", E + """, f AS (SELECT id FROM elements WHERE lower(layer)='brand#3' AND contains(lower(entity_type),'o') ORDER BY id)
SELECT id, (SELECT count(*)>20 FROM f) AS truncated FROM f ORDER BY id LIMIT 20""")
def _(t):
    rows, flag = X.entities(t.elements, "BRAND#3", "O", 20)
    return rows.select("id", F.lit(1).alias("one")).join(flag.withColumn("one", F.lit(1)), "one").select("id", "truncated")


# -- U ------------------------------------------------------------------------------------------------

@query("union_sources", "U1", "SELECT p_partkey AS id, 'part' AS source, p_size AS size, NULL::DOUBLE AS balance FROM part UNION ALL SELECT c_custkey, 'customer', NULL, c_acctbal FROM customer")
def _(t):
    a = t.part.select(F.col("p_partkey").alias("id"), F.lit("part").alias("source"), F.col("p_size").alias("size"))
    b = t.customer.select(F.col("c_custkey").alias("id"), F.lit("customer").alias("source"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("unmatched", "U3", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return t.customer.join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


# -- lookups that overlay tables ------------------------------------------------------------------------

@query("prefs_overlay", "J29", """WITH d AS (SELECT n_nationkey::BIGINT AS k, n_name AS value FROM nation), u AS (SELECT s_suppkey AS k, s_name AS value FROM supplier WHERE s_acctbal>0)
SELECT coalesce(d.k,u.k) AS k, coalesce(u.value,d.value) AS value, CASE WHEN u.k IS NULL THEN 'default' ELSE 'user' END AS source FROM d FULL JOIN u ON u.k=d.k""")
def _(t):
    d = t.nation.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("value"))
    return K.overlay(d, t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("value")), ["k"])


@query("project_priorities", "J30", """WITH p AS (SELECT DISTINCT c_nationkey AS project_id FROM customer), r AS (SELECT s_nationkey AS project_id, s_name AS system, 1 AS priority FROM supplier WHERE s_acctbal>5000)
SELECT project_id, system, priority FROM r UNION ALL SELECT project_id, v.system, v.priority FROM p, (VALUES ('plumbing',10),('hvac',20),('electrical',30)) v(system,priority) WHERE project_id NOT IN (SELECT project_id FROM r)""")
def _(t):
    rows = t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("project_id"), F.col("s_name").alias("system"), F.lit(1).alias("priority"))
    defaults = t.spark.createDataFrame([("plumbing", 10), ("hvac", 20), ("electrical", 30)], "system string, priority int")
    return K.project_rows_or_default(t.customer.select(F.col("c_nationkey").alias("project_id")), rows, defaults)


@query("merge_relevant", "J28", ctes("facts") + "SELECT id FROM facts WHERE confidence>=0.7 OR contains(lower(key),'err') OR contains(lower(value),'err')")
def _(t):
    return M.merge_relevant(t.facts.where("confidence >= 0.7"), M.facts_keyword(t.facts, "err")).select("id")
