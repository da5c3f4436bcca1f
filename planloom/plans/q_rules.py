"""Registered queries: rule matching, design checks, coverage and suggestions."""

from pyspark.sql import functions as F

from planloom.operators import rules as L
from planloom.plans.bind import ctes
from planloom.plans.registry import query

RULES = [
    dict(rule_name="duct_clearance", rule_type="clearance", element_types=["PROMO", "ECONOMY"], near_types=["beam"], priority=10, min_distance=1.5),
    dict(rule_name="any_clearance", rule_type="clearance", element_types=[], near_types=[], priority=30, min_distance=0.4),
    dict(rule_name="velocity", rule_type="sizing", subdomain="hvac", element_types=["PROMO"], priority=20, max_velocity=1200.0, severity="warning"),
    dict(rule_name="flow", rule_type="sizing", subdomain="plumbing", element_types=["ECONOMY"], priority=25, min_flow=300.0),
    dict(rule_name="slope", rule_type="routing", element_types=["SMALL", "STANDARD"], priority=40, min_slope=2.0),
    dict(rule_name="access", rule_type="access", element_types=["LARGE"], near_types=["wall", "column"], priority=50, min_clearance=0.9),
]


def checked(t):
    """Every part as an element with measured properties; category words hold the element type."""
    k, s = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("id"), (k % 5).alias("project_id"), F.col("p_type").alias("element_type"),
        F.concat_ws(" ", F.lower("p_type"), "p_name").alias("category"),
        F.when(k % 2 == 0, "hvac").otherwise("plumbing").alias("element_subdomain"), (s / 10).alias("clearance"), (s * 40.0).alias("velocity"),
        (s * 12.0).alias("flow"), (s / 10).alias("slope"), F.when(k % 3 > 0, s / 30).alias("access_clearance"), (k % 4 == 0).alias("near_structure"))


def rule_sql():
    lit = lambda v: "NULL" if v is None else repr(v)
    arr = lambda v: "[" + ",".join(repr(x) for x in v or []) + "]::VARCHAR[]"
    rows = ", ".join("(" + ", ".join([
        lit(r["rule_name"]), lit(r["rule_type"]), lit(r.get("subdomain")), arr(r.get("element_types")), arr(r.get("near_types")), str(r["priority"]),
        *[f"{r[c]}::DOUBLE" if r.get(c) is not None else "NULL::DOUBLE" for c in ("min_distance", "max_velocity", "min_flow", "min_slope", "min_clearance")],
        lit(r.get("severity"))]) + ")" for r in RULES)
    return f"r(rule_name, rule_type, subdomain, element_types, near_types, priority, min_distance, max_velocity, min_flow, min_slope, min_clearance, severity) AS (VALUES {rows})"


EL = """e AS (SELECT p_partkey AS id, p_partkey%5 AS project_id, p_type AS element_type, lower(p_type)||' '||p_name AS category, CASE WHEN p_partkey%2=0 THEN 'hvac' ELSE 'plumbing' END AS element_subdomain,
 p_size/10e0 AS clearance, p_size*40e0 AS velocity, p_size*12e0 AS flow, p_size/10e0 AS slope, CASE WHEN p_partkey%3>0 THEN p_size/30e0 END AS access_clearance FROM part)"""
MATCH = f"""{EL}, {rule_sql()}, m AS (SELECT * FROM e JOIN r ON (len(element_types)=0 OR list_contains(element_types, element_type)) AND (subdomain IS NULL OR subdomain=element_subdomain)),
v AS (SELECT *, CASE WHEN rule_type='clearance' THEN CASE WHEN clearance<min_distance THEN 'error' ELSE 'pass' END WHEN rule_type='sizing' AND velocity>max_velocity THEN CASE WHEN severity='warning' THEN 'warning' ELSE 'error' END
 WHEN rule_type='sizing' AND flow<min_flow THEN 'warning' WHEN rule_type='routing' AND slope<min_slope THEN 'error' WHEN rule_type='access' AND access_clearance<min_clearance THEN 'warning' END AS status FROM m)"""


def table(t):
    return L.rule_table(t.spark, RULES)


@query("applicable_rules", "R1", f"WITH {MATCH} SELECT id, rule_name, priority FROM m")
def _(t):
    return L.applicable_rules(checked(t), table(t)).select("id", "rule_name", "priority")


# rules on any attribute: (name, {attribute: values})
WIDE_RULES = [
    ("urgent_open", {"action": ["1-URGENT", "2-HIGH"], "space_type": ["O"]}), ("near_returned", {"near": ["R", "A"], "element_type": ["N"]}),
    ("returned", {"element_type": ["R"]}), ("always", {}), ("settled", {"phase": ["BUILD"], "space_type": ["F", "P"]}), ("never", {"element_type": ["?"]}),
    ("unknown_attribute", {"weather": ["rain"]}), ("quiet", {"action": ["5-LOW"], "near": ["N"], "element_type": ["A", "R"], "space_type": ["F"]}),
]


@query("contextual_rules", "R1", """WITH near AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS near FROM lineitem WHERE l_linenumber>1 GROUP BY ALL),
c AS (SELECT l_orderkey AS id, l_returnflag AS element_type, CASE WHEN o_orderkey%7<>0 THEN o_orderpriority END AS action, o_orderstatus AS space_type, near.near FROM lineitem JOIN orders ON o_orderkey=l_orderkey LEFT JOIN near ON near.k=l_orderkey WHERE l_linenumber=1),
m AS (SELECT id, unnest(['always','unknown_attribute', CASE WHEN coalesce(action IN ('1-URGENT','2-HIGH'),true) AND space_type='O' THEN 'urgent_open' END,
 CASE WHEN coalesce(len(list_intersect(near,['R','A']))>0,true) AND element_type='N' THEN 'near_returned' END, CASE WHEN element_type='R' THEN 'returned' END, CASE WHEN space_type IN ('F','P') THEN 'settled' END,
 CASE WHEN coalesce(action='5-LOW',true) AND coalesce(list_contains(near,'N'),true) AND element_type IN ('A','R') AND space_type='F' THEN 'quiet' END]) AS rule_name FROM c)
SELECT id, rule_name FROM m WHERE rule_name IS NOT NULL""")
def _(t):
    """Orders as elements: the first line gives the type, the other lines the neighbours; every seventh has no action."""
    first = t.lineitem.where("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("element_type"))
    near = t.lineitem.where("l_linenumber > 1").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set("l_returnflag").alias("near_elements"))
    facts = t.orders.select(F.col("o_orderkey").alias("id"), F.create_map(
        F.lit("action"), F.when(F.col("o_orderkey") % 7 != 0, F.array("o_orderpriority")), F.lit("space_type"), F.array("o_orderstatus")).alias("context"))
    e = first.join(facts, "id").join(near, "id", "left").withColumn("element_subdomain", F.lit(None).cast("string"))
    rules = t.spark.createDataFrame([(n, None, c.get("element_type"), c.get("near"), {k: v for k, v in c.items() if k not in ("element_type", "near")}) for n, c in WIDE_RULES],
                                    "rule_name string, subdomain string, element_types array<string>, near_types array<string>, conditions map<string,array<string>>")
    return L.applicable_rules(e, rules).select("id", "rule_name")


@query("rules_sorted", "K8 R2", f"WITH {EL}, {rule_sql()}, d AS (SELECT DISTINCT element_type FROM e) SELECT d.element_type, r.rule_name, r.priority FROM d JOIN r ON rule_type='clearance' AND (len(element_types)=0 OR list_contains(element_types, d.element_type)) AND (len(near_types)=0 OR list_contains(near_types,'beam'))")
def _(t):
    """Clearance rules near a beam for every element type in the table, by priority."""
    rules = L.clearance_rules(table(t), near_type="beam").withColumn("subdomain", F.lit(None).cast("string"))
    types = checked(t).select("element_type", F.lit(None).cast("string").alias("element_subdomain")).distinct()
    return L.applicable_rules(types, rules).select("element_type", "rule_name", "priority").orderBy("element_type", "priority")


@query("validate", "R3 R4 R5 R6", f"WITH {MATCH} SELECT id, rule_name, status FROM v WHERE status IS NOT NULL")
def _(t):
    return L.validate(checked(t), table(t)).select("id", "rule_name", "status")


@query("validation_summary", "A4", f"""WITH {MATCH}, f AS (SELECT project_id, id, rule_name, row_number() OVER (PARTITION BY project_id ORDER BY id, rule_name) AS rn FROM v WHERE status IN ('error','warning'))
SELECT project_id, count(*) AS total, count(*) FILTER (WHERE status='pass') AS "pass", count(*) FILTER (WHERE status='warning') AS warning, count(*) FILTER (WHERE status='error') AS error,
 (SELECT string_agg(id||':'||rule_name, ',' ORDER BY id, rule_name) FROM f WHERE rn<=20 AND f.project_id=v.project_id) AS details FROM v WHERE status IS NOT NULL GROUP BY project_id""")
def _(t):
    return L.validation_summary(L.validate(checked(t), table(t)), ["project_id"])


@query("suggest", "R7", """WITH s AS (SELECT p_partkey AS id, p_name LIKE '%ring%' AS duct, p_name LIKE '%widget%' AS equip, p_size*40e0 AS v, p_partkey%3=0 AS noacc, p_partkey%4=0 AS st FROM part)
SELECT id, 'sizing' AS suggestion_type, 'high velocity' AS reason, 60 AS priority FROM s WHERE duct AND v>1500 UNION ALL SELECT id, 'sizing', 'oversized', 40 FROM s WHERE duct AND v>0 AND v<400
UNION ALL SELECT id, 'access', 'service access', 70 FROM s WHERE equip AND noacc UNION ALL SELECT id, 'routing', 'parallel to structure', 50 FROM s WHERE st""")
def _(t):
    e = checked(t).withColumn("category", F.replace(F.replace("category", F.lit("ring"), F.lit("duct")), F.lit("widget"), F.lit("equipment")))
    return L.suggest(e)


# part types stand in for element categories
PAIRS = [("promo", "economy", 3.0), ("economy", "small", 2.5), ("large", "large", 4.0)]


@query("clearance_pairs", "R8", ctes("elements") + """, p AS (SELECT a.project_id, a.id AS id1, b.id AS id2, lower(a.entity_type) AS t1, lower(b.entity_type) AS t2,
 sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+(a.z-b.z)*(a.z-b.z)) AS distance FROM elements a JOIN elements b ON a.project_id=b.project_id AND a.id<b.id WHERE NOT a.deleted AND NOT b.deleted),
q AS (SELECT *, CASE WHEN t1||t2 IN ('promoeconomy','economypromo') THEN 3e0 WHEN t1||t2 IN ('economysmall','smalleconomy') THEN 2.5e0 WHEN t1='large' AND t2='large' THEN 4e0 ELSE 1e0 END AS required FROM p WHERE distance<=5)
SELECT project_id, id1, id2, distance, required, CASE WHEN distance<required*0.5 THEN 'error' ELSE 'warning' END AS severity FROM q WHERE distance<required""")
def _(t):
    return L.clearance_pairs(t.elements.where("not deleted").withColumn("category", F.col("entity_type")), PAIRS, 5.0, 1.0)


@query("duct_velocity", "R9 R13", """WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey%4=0 THEN p_size*90e0 ELSE p_size*200e0/(p_partkey%5+1) END AS v,
 CASE p_partkey%5 WHEN 0 THEN 'supply_main' WHEN 1 THEN 'supply_branch' WHEN 2 THEN 'return_main' WHEN 3 THEN 'exhaust' ELSE 'supply_branch' END AS kind,
 CASE p_partkey%3 WHEN 0 THEN 0.7e0 WHEN 1 THEN 1.2e0 ELSE 1e0 END AS f FROM part), l AS (SELECT *, CASE kind WHEN 'supply_main' THEN 4000 WHEN 'supply_branch' THEN 2000 WHEN 'return_main' THEN 4500 ELSE 3000 END * f AS max_v,
 CASE kind WHEN 'supply_branch' THEN 600 WHEN 'exhaust' THEN 800 ELSE 1000 END AS min_v FROM d)
SELECT id, kind, v, max_v, CASE WHEN v>max_v THEN CASE WHEN v<max_v*1.2 THEN 'warning' ELSE 'error' END ELSE 'info' END AS severity FROM l WHERE v>max_v OR v<min_v""")
def _(t):
    k, s = F.col("p_partkey"), F.col("p_size")
    name = F.when(k % 5 == 0, "Supply Main").when(k % 5 == 1, "supply duct").when(k % 5 == 2, "return riser").when(k % 5 == 3, "x").otherwise("duct")
    system = F.when(k % 5 == 3, "Exhaust Air").otherwise("")
    space = F.when(k % 3 == 0, "Office").when(k % 3 == 1, "mechanical").otherwise("general")
    d = t.part.select(k.alias("id"), name.alias("name"), system.alias("system"), F.when(k % 4 == 0, s * 90.0).alias("velocity"), (s * 200).alias("cfm"),
                      (k % 5 + 1).cast("double").alias("area"), space.alias("space_type"))
    return L.duct_velocity(d)


@query("pipe_velocity", "R9 R13", """WITH p AS (SELECT p_partkey AS id, 0.4085*p_size*4/((p_partkey%4+1)*(p_partkey%4+1)) AS v, CASE p_partkey%3 WHEN 0 THEN 'hot_water' WHEN 1 THEN 'chilled_water' ELSE 'cold_water' END AS kind FROM part),
 l AS (SELECT *, CASE kind WHEN 'hot_water' THEN 5e0 WHEN 'chilled_water' THEN 10e0 ELSE 8e0 END AS max_v FROM p) SELECT id, v::DOUBLE AS v, kind, max_v, CASE WHEN v<max_v*1.2 THEN 'warning' ELSE 'error' END AS severity FROM l WHERE v>max_v""")
def _(t):
    k = F.col("p_partkey")
    name = F.when(k % 3 == 0, "Hot supply").when(k % 3 == 1, "chilled run").otherwise("line")
    return L.pipe_velocity(t.part.select(k.alias("id"), name.alias("name"), F.lit("").alias("system"), F.lit(None).cast("double").alias("velocity"),
                                         (F.col("p_size") * 4).alias("gpm"), (k % 4 + 1).cast("double").alias("diameter")))


@query("drain_slope", "R10 R13", """WITH d AS (SELECT p_partkey AS id, CASE WHEN p_partkey%2=0 THEN p_size/10e0 ELSE p_size/1000e0*100 END AS s, CASE p_partkey%4 WHEN 0 THEN 'condensate' WHEN 1 THEN 'vent' WHEN 2 THEN 'sanitary' ELSE 'gravity_drain' END AS kind FROM part)
SELECT id, s, kind, CASE kind WHEN 'condensate' THEN 1e0 WHEN 'vent' THEN 0e0 ELSE 2e0 END AS min_slope FROM d WHERE s<CASE kind WHEN 'condensate' THEN 1e0 WHEN 'vent' THEN 0e0 ELSE 2e0 END""")
def _(t):
    k, s, z = F.col("p_partkey"), F.col("p_size"), F.lit(0.0)
    name = F.when(k % 4 == 0, "Condensate line").when(k % 4 == 1, "vent stack").when(k % 4 == 2, "Sanitary main").otherwise("drain")
    d = t.part.select(k.alias("id"), name.alias("name"), F.lit("").alias("system"), F.when(k % 2 == 0, s / 10).alias("slope"), z.alias("x1"), z.alias("y1"),
                      z.alias("z1"), F.lit(6.0).alias("x2"), F.lit(8.0).alias("y2"), (s / 100).alias("z2"))
    return L.slope(d)


@query("steep_offsets", "R10", "SELECT p_partkey AS id, p_size*2 AS offset_angle FROM part WHERE p_size*2>45")
def _(t):
    return L.offset(t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("offset_angle")))


IN_ROOM = "h AS (SELECT s.id, s.kind, s.x, s.y, min(r.id) AS room_id FROM symbols s JOIN rooms r ON r.project_id=s.project_id AND s.x BETWEEN r.x0 AND r.x1 AND s.y BETWEEN r.y0 AND r.y1 GROUP BY ALL)"


def devices(t):
    """Symbols with the first room whose box holds them."""
    from planloom.operators.relations import BOX
    from planloom.operators.spatial import overlap_pairs
    rooms = t.rooms.select("id", "project_id", F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), F.col("x1").alias("max_x"), F.col("y1").alias("max_y"))
    s = t.symbols.select("id", "project_id", "kind", "x", "y", F.col("x").alias("min_x"), F.col("y").alias("min_y"), F.col("x").alias("max_x"), F.col("y").alias("max_y"))
    hit = overlap_pairs(s, rooms, BOX, on=["project_id"])
    return hit.groupBy(F.col("a.id").alias("id"), F.col("a.kind").alias("kind"), F.col("a.x").alias("x"), F.col("a.y").alias("y")).agg(F.min("b.id").alias("room_id"))


def coverage(t, per, severity):
    rooms = t.rooms.select(F.col("id").alias("room_id"), ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area"))
    return L.coverage(rooms, devices(t).where("kind = 'diffuser'"), F.lit(float(per)), severity)


def cov_sql(per, severity):
    return ctes("rooms", "symbols") + f""", {IN_ROOM}, c AS (SELECT r.id AS room_id, (x1-x0)*(y1-y0) AS area, (SELECT count(*) FROM h WHERE h.room_id=r.id AND kind='diffuser') AS devices FROM rooms r)
SELECT room_id, area, devices, CASE WHEN devices=0 THEN 'error' ELSE '{severity}' END AS severity, CASE WHEN devices>0 THEN ceil(area/{per}e0)::BIGINT END AS recommended FROM c WHERE devices=0 OR area/devices>{per}"""


@query("diffuser_coverage", "R11", cov_sql(L.COVERAGE["diffuser_square"], "warning"))
def _(t):
    return coverage(t, L.COVERAGE["diffuser_square"], "warning")


@query("sprinkler_coverage", "R11", cov_sql(L.COVERAGE["sprinkler_ordinary"], "error"))
def _(t):
    return coverage(t, L.COVERAGE["sprinkler_ordinary"], "error")


@query("diffuser_spacing", "R12", ctes("rooms", "symbols") + f""", {IN_ROOM}, d AS (SELECT * FROM h)
SELECT a.room_id, a.id, count(*) AS far FROM d a JOIN d b ON a.room_id=b.room_id AND a.id<>b.id WHERE sqrt((a.x-b.x)^2+(a.y-b.y)^2)*3.281e0>15 GROUP BY ALL""")
def _(t):
    return L.diffuser_spacing(devices(t))


@query("infer_subdomain", "R13", """SELECT event_id AS id, CASE WHEN contains(c,'duct') THEN 'hvac' WHEN contains(c,'panel') OR contains(c,'switch') THEN 'electrical' WHEN contains(c,'valve') THEN 'plumbing' WHEN contains(c,'alarm') THEN 'fire_protection' ELSE 'mep' END AS subdomain
 FROM (SELECT event_id, CASE event_id%6 WHEN 0 THEN 'round duct' WHEN 1 THEN 'panel' WHEN 2 THEN 'switch' WHEN 3 THEN 'gate valve' WHEN 4 THEN 'alarm' ELSE event_type END AS c FROM events)""")
def _(t):
    k = F.col("event_id") % 6
    c = F.when(k == 0, "Round Duct").when(k == 1, "PANEL").when(k == 2, "switch").when(k == 3, "Gate Valve").when(k == 4, "alarm").otherwise(F.col("event_type"))
    return t.events.select(F.col("event_id").alias("id"), L.infer_subdomain(c).alias("subdomain"))
