"""Registered queries: annotations, text association, text classification, standards and scalar text rules."""

from pyspark.sql import functions as F

from planloom.functions import geom, intents, naming
from planloom.functions import text as T
from planloom.operators import standards as D
from planloom.operators import texts as X
from planloom.plans.bind import ctes
from planloom.plans.registry import query
from planloom.staging import materialize

KIND = "CASE id%6 WHEN 0 THEN 'equipment_tag' WHEN 1 THEN 'flow_rate' WHEN 2 THEN 'room_number' WHEN 3 THEN 'size' WHEN 4 THEN 'area' ELSE 'unknown' END"
PARSED = f"pa AS (SELECT *, {KIND} AS annotation_type FROM annotations)"


def parsed(t):
    return X.parse_annotations(t.annotations)


def stored(t):
    """Parsed texts as a written table: the patterns run once although several joins read them."""
    return materialize(parsed(t), "annotations")


@query("parse_annotations", "T12", ctes("annotations") + f""", {PARSED} SELECT id, annotation_type,
 CASE id%6 WHEN 0 THEN 'identifier' WHEN 1 THEN 'equipment' WHEN 2 THEN 'identifier' WHEN 3 THEN 'equipment' WHEN 4 THEN 'measurement' ELSE 'unknown' END AS category,
 CASE WHEN id%6 IN (0,1,2,4) THEN id::VARCHAR WHEN id%6=3 THEN '24' END AS main FROM pa""")
def _(t):
    f = lambda n: F.try_element_at("fields", F.lit(n))
    return parsed(t).select("id", "annotation_type", "category",
                            F.coalesce(f("number"), f("cfm"), f("room_number"), f("area_sf"), f("height")).alias("main"))


@query("parse_stats", "A17", ctes("annotations") + " SELECT count(*) AS total, count(*) FILTER (WHERE id%6<5) AS pattern_matched, count(*) FILTER (WHERE id%6=5) AS unknown FROM annotations")
def _(t):
    return X.parse_stats(parsed(t))


ELEMS = """el AS (SELECT id, project_id, 'symbol' AS element_type, category, x-3 AS min_x, y-2 AS min_y, x+3 AS max_x, y+2 AS max_y FROM symbols
 UNION ALL SELECT id, project_id, 'room_boundary', NULL, x0, y0, x1, y1 FROM rooms
 UNION ALL SELECT id, project_id, 'geometry', NULL, least(x1,x2), least(y1,y2), greatest(x1,x2), greatest(y1,y2) FROM segments)"""


def elements(t):
    s = t.symbols.select("id", "project_id", F.lit("symbol").alias("element_type"), "category", (F.col("x") - 3).alias("min_x"),
                         (F.col("y") - 2).alias("min_y"), (F.col("x") + 3).alias("max_x"), (F.col("y") + 2).alias("max_y"))
    r = t.rooms.select("id", "project_id", F.lit("room_boundary").alias("element_type"), F.lit(None).cast("string").alias("category"),
                       F.col("x0").alias("min_x"), F.col("y0").alias("min_y"), F.col("x1").alias("max_x"), F.col("y1").alias("max_y"))
    g = geom.box_of_segments(t.segments).select("id", "project_id", F.lit("geometry").alias("element_type"),
                                                F.lit(None).cast("string").alias("category"), "min_x", "min_y", "max_x", "max_y")
    return s.unionByName(r).unionByName(g)


ASSOC = f"""{PARSED}, {ELEMS},
c AS (SELECT a.id AS annotation_id, a.project_id, a.annotation_type, a.text, e.id AS element_id, e.element_type,
 CASE a.annotation_type WHEN 'flow_rate' THEN 'specifies' WHEN 'size' THEN 'specifies' WHEN 'area' THEN 'specifies' ELSE 'labels' END AS relation,
 sqrt(greatest(0, greatest(e.min_x-a.x, a.x-e.max_x))^2+greatest(0, greatest(e.min_y-a.y, a.y-e.max_y))^2) AS distance,
 greatest(e.max_x-e.min_x, e.max_y-e.min_y) AS size, CASE a.annotation_type WHEN 'flow_rate' THEN 2.5e0 ELSE 2e0 END AS factor
 FROM pa a JOIN el e ON a.project_id=e.project_id WHERE CASE a.annotation_type WHEN 'equipment_tag' THEN e.element_type='symbol'
 WHEN 'flow_rate' THEN e.element_type='symbol' AND e.category='mechanical' WHEN 'size' THEN e.element_type IN ('symbol','geometry')
 WHEN 'room_number' THEN e.element_type='room_boundary' WHEN 'area' THEN e.element_type='room_boundary' ELSE false END),
k AS (SELECT *, row_number() OVER (PARTITION BY annotation_id ORDER BY distance, element_id) AS rn FROM c
 WHERE CASE WHEN element_type='room_boundary' THEN distance=0 ELSE distance<=greatest(factor*size, 100) END),
links AS (SELECT annotation_id, project_id, annotation_type, relation, element_id, element_type, distance,
 CASE WHEN distance=0 THEN 1e0 ELSE greatest(0e0, 1-distance/(3*greatest(size,1))) END AS confidence, text FROM k WHERE rn=1)"""


@query("associate_text", "J18 C5", ctes("annotations", "symbols", "rooms", "segments") + f", {ASSOC} SELECT annotation_id, project_id, annotation_type, relation, element_id, distance, confidence FROM links")
def _(t):
    return X.associate_text(stored(t), elements(t)).drop("element_type")


@query("element_tags", "A11", ctes("annotations", "symbols", "rooms", "segments") + f", {ASSOC} SELECT element_type, element_id, text AS tag FROM links WHERE annotation_type='equipment_tag'")
def _(t):
    a = stored(t)
    return X.annotations_by_element(X.associate_text(a, elements(t)), a)[0]


@query("element_specs", "A11", ctes("annotations", "symbols", "rooms", "segments") + f""", {ASSOC}, s AS (
 SELECT element_type, element_id, annotation_id, unnest(CASE annotation_type WHEN 'flow_rate' THEN [('cfm', annotation_id::VARCHAR)] ELSE [('width','24'),('height','24')] END) AS f FROM links WHERE annotation_type IN ('flow_rate','size'))
SELECT element_type, element_id, f[1] AS field, arg_max(f[2], annotation_id) AS value FROM s GROUP BY ALL""")
def _(t):
    a = stored(t)
    return X.annotations_by_element(X.associate_text(a, elements(t)), a)[1]


@query("room_annotations", "J19", ctes("annotations", "rooms") + f""", {PARSED},
h AS (SELECT a.id, a.text, a.annotation_type, min(r.id) AS room_id FROM pa a JOIN rooms r ON a.project_id=r.project_id AND a.x BETWEEN r.x0 AND r.x1 AND a.y BETWEEN r.y0 AND r.y1
 WHERE annotation_type IN ('room_number','area') GROUP BY ALL)
SELECT r.id AS room_id, CAST(NULL AS VARCHAR) AS name, arg_max(h.id::VARCHAR, h.id) FILTER (WHERE annotation_type='room_number') AS number,
 arg_max(h.id::DOUBLE, h.id) FILTER (WHERE annotation_type='area') AS area_sf, CAST(NULL AS DOUBLE) AS area_m2, count(h.id) AS n_texts FROM rooms r LEFT JOIN h ON h.room_id=r.id GROUP BY r.id""")
def _(t):
    rooms = t.rooms.withColumnsRenamed({"x0": "min_x", "y0": "min_y", "x1": "max_x", "y1": "max_y"})
    return X.room_annotations(stored(t), rooms)


@query("leader_targets", "J20", ctes("segments", "symbols", "annotations") + """,
d AS (SELECT s.id AS leader_id, a.id AS text_id, sqrt((a.x-s.x1)^2+(a.y-s.y1)^2) AS ds, sqrt((a.x-s.x2)^2+(a.y-s.y2)^2) AS de FROM segments s JOIN annotations a ON a.project_id=s.project_id),
b AS (SELECT *, row_number() OVER (PARTITION BY leader_id ORDER BY least(ds,de), text_id) AS rn FROM d WHERE least(ds,de)<20),
o AS (SELECT b.leader_id, b.text_id, s.project_id, CASE WHEN ds<de THEN s.x2 ELSE s.x1 END AS x, CASE WHEN ds<de THEN s.y2 ELSE s.y1 END AS y FROM b JOIN segments s ON s.id=b.leader_id WHERE rn=1),
q AS (SELECT o.leader_id, o.text_id, y.id AS symbol_id, row_number() OVER (PARTITION BY o.leader_id ORDER BY sqrt((o.x-y.x)^2+(o.y-y.y)^2), y.id) AS rn FROM o JOIN symbols y ON y.project_id=o.project_id WHERE sqrt((o.x-y.x)^2+(o.y-y.y)^2)<20)
SELECT leader_id, text_id, symbol_id FROM q WHERE rn=1""")
def _(t):
    return X.leader_targets(t.segments, t.symbols, t.annotations, 20.0)


@query("nearby_text", "J21", ctes("symbols", "annotations") + """, d AS (SELECT s.id AS symbol_id, a.id AS text_id, sqrt((s.x-a.x)^2+(s.y-a.y)^2) AS distance FROM symbols s JOIN annotations a ON a.project_id=s.project_id)
SELECT symbol_id, text_id, distance, rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol_id ORDER BY distance, text_id) AS rn FROM d WHERE distance<=40) WHERE rn<=3""")
def _(t):
    return X.nearby_text(t.symbols, t.annotations, 40.0, 3).select("symbol_id", "text_id", "distance", "rn")


@query("enrich_symbols", "J31", ctes("symbols", "annotations") + """, m AS (SELECT s.id, min(a.id) AS match_id FROM symbols s JOIN annotations a ON a.project_id=s.project_id AND sqrt((s.x-a.x)^2+(s.y-a.y)^2)<50 GROUP BY s.id)
SELECT s.id, m.match_id, a.text AS tag FROM symbols s LEFT JOIN m USING (id) LEFT JOIN annotations a ON a.id=m.match_id""")
def _(t):
    sem = t.annotations.select("id", "project_id", "x", "y", F.col("text").alias("tag"), F.lit(None).cast("string").alias("size"))
    return X.enrich_symbols(t.symbols, sem).select("id", "match_id", F.try_element_at("attributes", F.lit("TAG")).alias("tag"))


def q(s):
    return "'" + s.replace("'", "''") + "'"


def score_sql(text, table, weight):
    return {k: " + ".join(f"(CASE WHEN contains({text},{q(w)}) THEN {weight(w)} ELSE 0 END)" for w in ws) for k, ws in table.items()}


_dt = score_sql("lt", X.DRAWING_TYPES, len)
_dt_cols = ", ".join(f"{v} AS s_{k}" for k, v in _dt.items())
_dt_top = "greatest(" + ",".join(f"s_{k}" for k in _dt) + ")"
_dt_case = "CASE " + " ".join(f"WHEN s_{k}=top THEN '{k}'" for k in _dt) + " END"


@query("classify_documents", "T8", f"""WITH l AS (SELECT doc_id, lower(text) AS lt FROM documents), s AS (SELECT doc_id, {_dt_cols} FROM l), t AS (SELECT *, {_dt_top} AS top FROM s)
SELECT doc_id, CASE WHEN top>0 THEN {_dt_case} ELSE 'unknown' END AS drawing_type, top::DOUBLE AS score, CASE WHEN top>0 THEN least(0.8e0, top/50e0) ELSE 0e0 END AS confidence FROM t""")
def _(t):
    return X.classify_documents(t.documents.select("doc_id", "text")).drop("text")


# words of the generated prose stand in for the vocabulary of requests
INTENTS = [("hvac", "the", 3.0, "equipment"), ("hvac", "that", 2.5, "terminals"), ("hvac", "on", 1.0, None),
           ("electrical", "les", 2.5, "devices"), ("electrical", "un", 2.0, "distribution"), ("electrical", "la", 1.5, None),
           ("plumbing", "der", 3.0, "fixtures"), ("plumbing", "und", 2.0, "fittings")]
ACTIONS = {"create": ["and", "est"], "modify": ["ich", "ment"], "delete": ["er"]}
APPS = {"autocad": ["ou", "eau", "re"], "revit": ["the", "and", "th"]}
_act = {k: " + ".join(f"contains(lt,{q(w)})::INT" for w in ws) for k, ws in ACTIONS.items()}
_app = {k: " + ".join(f"contains(lt,{q(w)})::INT" for w in ws) for k, ws in APPS.items()}


def intent_sql(texts, patterns, act, app):
    """Every pattern against every text as a regular expression; the first pattern and domain win ties."""
    rows = ", ".join(f"({i}, {q(d)}, {q(w)}, {wt}e0, {q(sub) if sub else 'NULL::VARCHAR'})" for i, (d, w, wt, sub) in enumerate(patterns))
    edge = "[^\\p{L}\\p{N}_]"
    hits = ", ".join(f"CASE WHEN regexp_matches(lt, {q(f'(^|{edge}){w}($|{edge})')}) THEN {i} END" for i, (_, w, *_) in enumerate(patterns))
    acts = ", ".join(f"{v} AS a_{k}" for k, v in act.items())
    best = "greatest(" + ",".join(f"a_{k}" for k in act) + ")"
    case = " ".join(f"WHEN a_{k}={best} THEN {q(k)}" for k in act)
    (n1, c1), (n2, c2) = app.items()
    return f"""WITH l AS ({texts}), p(no, domain, words, weight, subdomain) AS (VALUES {rows}), o AS (SELECT domain, min(no) AS dn FROM p GROUP BY ALL),
m AS (SELECT conv_id, turn, unnest([{hits}]) AS no FROM l),
h AS (SELECT conv_id, turn, domain, dn, sum(weight) AS score, arg_max(struct_pack(s := subdomain), (weight, -no)).s AS subdomain FROM m JOIN p USING (no) JOIN o USING (domain) GROUP BY ALL),
t AS (SELECT conv_id, turn, arg_max(struct_pack(d := domain, s := subdomain, v := score), (score, -dn)) AS b, sum(score) AS all_scores FROM h GROUP BY ALL),
s AS (SELECT *, {acts}, {c1} AS c1, {c2} AS c2 FROM l LEFT JOIN t USING (conv_id, turn))
SELECT conv_id, turn, coalesce(b.d, 'general') AS domain, b.s AS subdomain, CASE WHEN b IS NULL THEN 0e0 ELSE least(1e0, b.v/6)*0.6+b.v/all_scores*0.4 END AS confidence,
 CASE WHEN {best}=0 THEN 'query' {case} END AS action, CASE WHEN c1>=2 AND c1>c2*2 THEN {q(n1)} WHEN c2>=2 AND c2>c1*2 THEN {q(n2)} ELSE 'both' END AS app FROM s"""


@query("classify_intent", "T9 W8", intent_sql("SELECT conv_id, turn, lower(text) AS lt FROM conversations", INTENTS, _act, _app))
def _(t):
    return X.classify_intent(t.conversations.select("conv_id", "turn", "text"), INTENTS, ACTIONS, APPS).drop("text")


# every message asks for two things of the shipped vocabulary, by its number
_n = len(intents.PATTERNS)
_words = "[" + ",".join(q(w) for _, w, *_ in intents.PATTERNS) + "]"
ASKED = f"SELECT conv_id, turn, lower(concat(text, ' Show the ', {_words}[(conv_id*31+turn*7)%{_n}+1], ' (', {_words}[(conv_id*5+turn*11)%{_n}+1], ').')) AS lt FROM conversations"


@query("shipped_intents", "T9", intent_sql(ASKED, intents.PATTERNS, {k: " + ".join(f"contains(lt,{q(w)})::INT" for w in ws) for k, ws in intents.ACTIONS.items()},
                                           {k: " + ".join(f"contains(lt,{q(w)})::INT" for w in ws) for k, ws in intents.APPS.items()}))
def _(t):
    words = F.array(*[F.lit(w) for _, w, *_ in intents.PATTERNS])
    pick = lambda a, b: F.element_at(words, ((F.col("conv_id") * a + F.col("turn") * b) % _n + 1).cast("int"))
    m = t.conversations.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), F.lit(" Show the "), pick(31, 7), F.lit(" ("), pick(5, 11), F.lit(").")).alias("text"))
    return X.classify_intent(m, intents.PATTERNS, intents.ACTIONS, intents.APPS).drop("text")



_pf = {k: " + ".join(f"contains(fn,{q(w)})::INT + contains(lt,{q(w)})::INT + 3*contains(dt,{q(w)})::INT" for w in ws) for k, ws in X.PROFILES.items()}
_pf_cols = ", ".join(f"{v} AS s_{k}" for k, v in _pf.items())


@query("detect_profile", "T10", f"""WITH l AS (SELECT page_id, lower(url) AS fn, lower(html) AS lt, CASE page_id%3 WHEN 0 THEN 'mechanical' WHEN 1 THEN 'site plan' ELSE '' END AS dt FROM pages), s AS (SELECT page_id, {_pf_cols} FROM l),
 t AS (SELECT *, greatest({','.join('s_' + k for k in _pf)}) AS top FROM s) SELECT page_id, CASE WHEN top>0 THEN CASE {' '.join(f"WHEN s_{k}=top THEN '{k}'" for k in _pf)} END ELSE 'general' END AS profile, top::DOUBLE AS profile_score FROM t""")
def _(t):
    k = F.col("page_id") % 3
    d = t.pages.withColumn("dt", F.when(k == 0, "mechanical").when(k == 1, "site plan").otherwise(""))
    return X.detect_profile(d, "url", "html", "dt").select("page_id", "profile", "profile_score")


# -- standards ----------------------------------------------------------------------------------------------

def grounded(t):
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(v) for v in ("valve", "diffuser", "outlet", "pipe", "Smoke Detector", "widget")])
    subs = F.array(*[F.lit(v) for v in ("gate", "supply_square", None, "duplex", "ball")])
    e = t.part.select(k.alias("id"), (k % 7).alias("project_id"), F.get(kinds, (k % 6).cast("int")).alias("element_type"),
                      F.get(subs, (k % 5).cast("int")).alias("subtype"))
    std = lambda rows: t.spark.createDataFrame(rows, "discipline string, element_type string, subtype string, layer string, block string")
    project = t.spark.createDataFrame([(1, "plumbing", "valve", "gate", "PRJ-V", "PV1"), (2, "mechanical", "diffuser", "default", "PRJ-D", None)],
                                      "project_id bigint, discipline string, element_type string, subtype string, layer string, block string")
    company = std([("plumbing", "valve", "default", "CO-VALV", "CV"), ("electrical", "outlet", "duplex", "CO-OUT", "CO1")])
    file = std([("plumbing", "pipe", "default", "F-PIPE", None), ("fire", "smoke_detector", "ball", "F-SMK", "FS")])
    return D.standards_lookup(e, project, company, file)


GROUND = """e AS (SELECT p_partkey AS id, p_partkey%7 AS project_id, ['valve','diffuser','outlet','pipe','smoke_detector','widget'][p_partkey%6+1] AS k,
 ['gate','supply_square',NULL,'duplex','ball'][p_partkey%5+1] AS s FROM part),
g AS (SELECT *, CASE WHEN k='valve' AND project_id=1 AND s='gate' THEN 'project' WHEN k='diffuser' AND project_id=2 THEN 'project' WHEN k='valve' THEN 'company'
 WHEN k='outlet' AND s='duplex' THEN 'company' WHEN k='pipe' THEN 'file' WHEN k='smoke_detector' AND s='ball' THEN 'file' ELSE 'default' END AS source FROM e),
r AS (SELECT id, source, CASE source WHEN 'project' THEN CASE k WHEN 'valve' THEN 'PRJ-V' ELSE 'PRJ-D' END WHEN 'company' THEN CASE k WHEN 'valve' THEN 'CO-VALV' ELSE 'CO-OUT' END
 WHEN 'file' THEN CASE k WHEN 'pipe' THEN 'F-PIPE' ELSE 'F-SMK' END ELSE CASE k WHEN 'diffuser' THEN 'M-HVAC-DIFF' WHEN 'outlet' THEN 'E-POWR-OUTL' WHEN 'smoke_detector' THEN 'F-ALRM-DETC' ELSE '0' END END AS layer,
 CASE source WHEN 'project' THEN CASE k WHEN 'valve' THEN 'PV1' END WHEN 'company' THEN CASE k WHEN 'valve' THEN 'CV' ELSE 'CO1' END WHEN 'file' THEN CASE k WHEN 'smoke_detector' THEN 'FS' END
 ELSE CASE k WHEN 'diffuser' THEN 'M-DIFF' WHEN 'outlet' THEN 'E-OUTL' WHEN 'smoke_detector' THEN 'F-DETC-SMOK' END END AS block FROM g)"""


@query("standards_lookup", "J26 J27 T14", f"WITH {GROUND} SELECT * FROM r")
def _(t):
    return grounded(t).select("id", "source", "layer", "block")


@query("coverage_stats", "A12", f"""WITH {GROUND} SELECT count(*) AS total, count(*) FILTER (WHERE layer<>'0') AS applied, count(*) FILTER (WHERE layer='0') AS missing,
 count(*) FILTER (WHERE layer<>'0' AND source='project') AS from_project, count(*) FILTER (WHERE layer<>'0' AND source='company') AS from_company, count(*) FILTER (WHERE layer<>'0' AND source='file') AS from_file,
 count(*) FILTER (WHERE layer<>'0' AND source='default') AS from_default, count(*) FILTER (WHERE layer<>'0')*100e0/count(*) AS coverage_percent FROM r""")
def _(t):
    return D.coverage_stats(grounded(t))


# -- scalar rules (C, T13) --------------------------------------------------------------------------------------

@query("names_for_kinds", "T13 T14", ctes("symbols") + """ SELECT id, CASE kind WHEN 'diffuser' THEN 'M-DIFF' WHEN 'valve' THEN 'P-VALV' WHEN 'outlet' THEN 'E-POWR-OUTL' WHEN 'ahu' THEN 'M-EQPM' WHEN 'panel' THEN 'E-POWR-PANL' ELSE 'A-DOOR' END AS layer,
 CASE kind WHEN 'diffuser' THEN 'M-DIFF-GEN' WHEN 'valve' THEN 'P-VALV-GEN' WHEN 'outlet' THEN 'E-OUTL-GEN' ELSE upper(kind)||'-GEN' END AS block,
 CASE kind WHEN 'valve' THEN 'domestic_cold_water' WHEN 'outlet' THEN 'power' WHEN 'panel' THEN 'power' WHEN 'door' THEN 'unknown' ELSE 'supply_air' END AS system,
 CASE kind WHEN 'valve' THEN 'plumbing' WHEN 'outlet' THEN 'electrical' WHEN 'panel' THEN 'electrical' WHEN 'door' THEN 'unknown' ELSE 'mechanical' END AS discipline,
 CASE kind WHEN 'valve' THEN 5 WHEN 'outlet' THEN 1 WHEN 'panel' THEN 1 WHEN 'door' THEN 7 ELSE 5 END AS color FROM symbols""")
def _(t):
    k, none = F.col("kind"), F.lit(None).cast("string")
    s = t.symbols.withColumn("system", naming.infer_system(k))
    return s.select("id", naming.layer_for(k).alias("layer"), naming.block_for(k, none).alias("block"), "system",
                    naming.infer_discipline(k, F.col("system")).alias("discipline"), naming.color_for(F.col("system")).alias("color"))


@query("measurements", "C7 C8", """WITH m AS (SELECT p_partkey AS id, p_size AS n FROM part)
SELECT id, CASE id%7 WHEN 0 THEN n*12+6e0 WHEN 1 THEN n WHEN 2 THEN n*12 WHEN 3 THEN n WHEN 4 THEN n*10 WHEN 5 THEN n*1000 ELSE n END::DOUBLE AS value, CASE WHEN id%7 IN (3,4,5) THEN 'mm' ELSE 'inches' END AS unit,
 CASE id%7 WHEN 0 THEN (n*12+6e0)*25.4 WHEN 1 THEN n*25.4 WHEN 2 THEN n*12*25.4 WHEN 3 THEN n WHEN 4 THEN n*10 WHEN 5 THEN n*1000 ELSE n*25.4 END::DOUBLE AS mm FROM m""")
def _(t):
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    text = (F.when(k == 0, F.concat(n, F.lit("'-6\""))).when(k == 1, F.concat(n, F.lit("\""))).when(k == 2, F.concat(n, F.lit(" ft")))
            .when(k == 3, F.concat(n, F.lit("mm"))).when(k == 4, F.concat(n, F.lit(" cm"))).when(k == 5, F.concat(n, F.lit("m"))).otherwise(n))
    m = t.part.select(F.col("p_partkey").alias("id"), T.measurement(text).alias("m")).select("id", "m.value", "m.unit")
    return m.withColumn("mm", T.convert_units(F.col("value"), F.col("unit"), F.lit("mm")))


@query("best_calibration", "C8 C9", """WITH c AS (SELECT c_nationkey AS drawing, c_custkey AS id, CASE c_custkey%4 WHEN 0 THEN (c_custkey%9+1)*12e0/400 WHEN 1 THEN 48e0/300 WHEN 2 THEN 36e0/10000 ELSE 1e0/300 END AS units_per_pixel,
 CASE c_custkey%4 WHEN 0 THEN 0.9e0 WHEN 1 THEN 0.85e0 WHEN 2 THEN 0.7e0 ELSE 0.3e0 END AS confidence FROM customer)
SELECT drawing, arg_max(units_per_pixel, (confidence, -id)) AS units_per_pixel, max(confidence) AS confidence FROM c GROUP BY drawing""")
def _(t):
    k = F.col("c_custkey")
    dim = T.measurement(F.concat((k % 9 + 1).cast("string"), F.lit("'-0\"")))["value"] / 400.0
    scale = T.scale_per_pixel(F.lit("1/4\" = 1'-0\""), F.lit(300.0))["value"]
    sheet = T.sheet_size(F.lit("ARCH D (24x36)"))["height"] / 10000.0
    c = t.customer.select(F.col("c_nationkey").alias("drawing"), k.alias("id"),
                          F.when(k % 4 == 0, dim).when(k % 4 == 1, scale).when(k % 4 == 2, sheet).otherwise(F.lit(1.0) / 300.0).alias("upp"),
                          F.when(k % 4 == 0, 0.9).when(k % 4 == 1, 0.85).when(k % 4 == 2, 0.7).otherwise(0.3).alias("confidence"))
    return c.groupBy("drawing").agg(F.max_by("upp", F.struct("confidence", -F.col("id"))).alias("units_per_pixel"), F.max("confidence").alias("confidence"))


@query("pixel_transform", "C6", ctes("symbols") + " SELECT id, (x-10)*0.5 AS dx, (600-y-20)*0.5 AS dy, x AS px, y AS py FROM symbols")
def _(t):
    s, ox, oy, h = F.lit(0.5), F.lit(10.0), F.lit(20.0), F.lit(600.0)
    d = t.symbols.select("id", *[c.alias(n) for c, n in zip(geom.pixel_to_drawing(F.col("x"), F.col("y"), s, ox, oy, h), ("dx", "dy"))])
    return d.select("id", "dx", "dy", *[c.alias(n) for c, n in zip(geom.drawing_to_pixel(F.col("dx"), F.col("dy"), s, ox, oy, h), ("px", "py"))])


@query("segment_measures", "C4", ctes("segments") + " SELECT id, sqrt((x2-x1)^2+(y2-y1)^2) AS length, CASE WHEN y2>y1 THEN 90e0 ELSE 0e0 END AS angle, (x1+x2)/2 AS mx, (y1+y2)/2 AS my FROM segments")
def _(t):
    mx, my = geom.mid()
    return t.segments.select("id", geom.length().alias("length"), geom.angle360().alias("angle"), mx.alias("mx"), my.alias("my"))


@query("descriptions", "C10 C11", """WITH p AS (SELECT *, p_size/10e0 AS m FROM part) SELECT p_partkey AS id, CASE WHEN p_partkey%2=0 THEN
 'LINE on layer '||p_brand||', length '||CASE WHEN m<1 THEN printf('%.1fcm', m*100) ELSE printf('%.2fm', m) END||', at ('||printf('%.1f', (p_partkey%100)::DOUBLE)||', '||printf('%.1f', p_size::DOUBLE)||')'
 ELSE 'Walls: '||p_name||' - '||p_type||', height '||CASE WHEN m<1 THEN printf('%.1fcm', m*100) ELSE printf('%.2fm', m) END||', on L'||p_partkey%4 END AS description FROM p""")
def _(t):
    k, m = F.col("p_partkey"), (F.col("p_size") / 10).cast("string")
    a = T.describe_entity(F.lit("LINE"), F.col("p_brand"), F.create_map(F.lit("length"), m), (k % 100).cast("double"), F.col("p_size").cast("double"))
    b = T.describe_component(F.lit("Walls"), F.col("p_name"), F.col("p_type"), F.create_map(F.lit("HEIGHT"), m, F.lit("level"), F.concat(F.lit("L"), k % 4)))
    return t.part.select(k.alias("id"), F.when(k % 2 == 0, a).otherwise(b).alias("description"))


@query("line_styles", "C13 C14", """SELECT p_partkey AS id, CASE p_size%4 WHEN 0 THEN 0.0e0 WHEN 1 THEN 0.18e0 WHEN 2 THEN 0.35e0 ELSE 0.7e0 END AS weight,
 CASE p_size%4 WHEN 0 THEN 'A-ANNO-NOTE' WHEN 1 THEN 'A-ANNO-DIMS' WHEN 2 THEN 'A-FLOR' ELSE 'A-WALL' END AS layer,
 CASE WHEN p_partkey%5=0 THEN 'CONTINUOUS' WHEN p_size<20 THEN 'DOTTED' WHEN p_size BETWEEN 40 AND 60 THEN 'HIDDEN' ELSE 'DASHED' END AS linetype FROM part""")
def _(t):
    n = F.col("p_size") % 4
    w = T.lineweight(F.when(n == 0, 0.0).when(n == 1, 0.185).when(n == 2, 0.36).otherwise(0.69))
    gaps = F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(4)
    lt = T.linetype_of(F.col("p_size") / 100, gaps, F.array(F.lit(5.0), F.lit(-2.0), F.lit(5.0), F.lit(-2.0)))
    return t.part.select(F.col("p_partkey").alias("id"), w.alias("weight"), T.thickness_layer(T.thickness_class(w)).alias("layer"), lt.alias("linetype"))


@query("expand_shortcuts", "C16", """SELECT c_custkey AS id, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'home goods '||c_custkey WHEN 'MACHINERY' THEN 'machines '||c_custkey ELSE c_mktsegment||' '||c_custkey END AS text FROM customer""")
def _(t):
    alias = t.spark.createDataFrame([("household", "home goods"), ("machinery", "machines")], "alias string, expansion string")
    c = t.customer.select(F.col("c_custkey").alias("id"), F.concat_ws(" ", "c_mktsegment", F.col("c_custkey").cast("string")).alias("text"))
    j = c.withColumn("alias", F.lower(F.split_part("text", F.lit(" "), F.lit(1)))).join(F.broadcast(alias), "alias", "left")
    return j.select("id", T.expand_shortcut(F.col("text"), F.col("expansion")).alias("text"))


@query("shortcut_usage", "C16", "SELECT event_type AS alias, count(*) AS uses, max(ts) AS last_used FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("alias")).agg(F.count(F.lit(1)).alias("uses"), F.max("ts").alias("last_used"))


@query("action_templates", "C17", "SELECT p_partkey AS id, 'keep '||p_size||' mm from '||p_type||' {missing}' AS message FROM part")
def _(t):
    vals = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("kind"), F.col("p_type"))
    return t.part.select(F.col("p_partkey").alias("id"), T.fill_template(F.lit("keep {size} mm from {kind} {missing}"), vals, ["size", "kind", "missing"]).alias("message"))


@query("vector_text", "C18", "SELECT vec_id AS id, round(embedding[1]::DOUBLE,6) AS head, len(embedding) AS n FROM embeddings")
def _(t):
    s = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ","), F.lit("]"))
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.from_json(s, "array<float>").alias("v"))
    return v.select("id", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("head"), F.size("v").cast("long").alias("n"))


@query("wkt_text", "C1 C2", ctes("segments", "rooms") + """ SELECT 'line' AS kind, id, 'LINESTRING Z('||x1||' '||y1||' 0.0, '||x2||' '||y2||' 0.0)' AS wkt FROM segments
UNION ALL SELECT 'room', id, 'POLYGON Z(('||x0||' '||y0||' 0.0, '||x1||' '||y0||' 0.0, '||x1||' '||y1||' 0.0, '||x0||' '||y0||' 0.0))' FROM rooms""")
def _(t):
    pt = lambda x, y: geom.point(F.col(x), F.col(y))
    lines = t.segments.select(F.lit("line").alias("kind"), "id", geom.wkt(F.array(pt("x1", "y1"), pt("x2", "y2"))).alias("wkt"))
    rooms = t.rooms.select(F.lit("room").alias("kind"), "id", geom.wkt(F.array(
        pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y0")), F.lit(True)).alias("wkt"))
    return lines.unionByName(rooms)


@query("curve_points", "C3", """WITH c AS (SELECT p_partkey AS id, (p_partkey%100)::DOUBLE AS cx, p_size::DOUBLE AS r, (p_partkey%360)::DOUBLE AS a, CASE WHEN p_partkey*7%360<p_partkey%360 THEN p_partkey*7%360+360e0 ELSE (p_partkey*7%360)::DOUBLE END AS b FROM part)
SELECT id, 'circle' AS kind, i AS seq, cx+r*cos(2*pi()*i/32) AS x, 5+r*sin(2*pi()*i/32) AS y FROM c, range(33) t(i)
UNION ALL SELECT id, 'arc', i, cx+r*cos(radians(a+(b-a)*i/16)), 5+r*sin(radians(a+(b-a)*i/16)) FROM c, range(17) t(i)""")
def _(t):
    k = F.col("p_partkey")
    cx, cy, r = (k % 100).cast("double"), F.lit(5.0), F.col("p_size").cast("double")
    circle = t.part.select(k.alias("id"), F.lit("circle").alias("kind"), F.posexplode(geom.ring_points(cx, cy, r)).alias("seq", "p"))
    arc = t.part.select(k.alias("id"), F.lit("arc").alias("kind"), F.posexplode(geom.arc_points(
        cx, cy, r, (k % 360).cast("double"), (k * 7 % 360).cast("double"))).alias("seq", "p"))
    return circle.unionByName(arc).select("id", "kind", F.col("seq").cast("long").alias("seq"), "p.x", "p.y")


@query("explode_analysis", "S19 C6 T13", """SELECT p_partkey AS doc_id, 'line' AS entity_kind, 'A-WALL' AS layer, (p_size-2)*0.5e0 AS x1, (100-p_size-4)*0.5e0 AS y1, NULL::DOUBLE AS cx, NULL::DOUBLE AS radius, NULL AS text, 'HIDDEN' AS linetype FROM part
UNION ALL SELECT p_partkey, 'circle', 'M-DUCT', NULL, NULL, (p_partkey%90-2)*0.5e0, p_size*0.5e0, NULL, NULL FROM part
UNION ALL SELECT p_partkey, 'mtext', 'G-ANNO-TAGS', NULL, NULL, (p_size-2)*0.5e0, NULL, p_name, NULL FROM part
UNION ALL SELECT p_partkey, 'block', 'P-VALV', NULL, NULL, (p_size*2-2)*0.5e0, NULL, p_brand, NULL FROM part""")
def _(t):
    from planloom.sources import entities as S
    k, s = F.col("p_partkey"), F.col("p_size")
    d = lambda c: c.cast("double")
    doc = F.to_json(F.struct(
        F.array(F.struct(d(s).alias("x1"), d(s).alias("y1"), d(s + 9).alias("x2"), d(s).alias("y2"), F.lit("wall").alias("kind"), F.lit("dashed").alias("linetype"))).alias("lines"),
        F.array(F.struct(d(k % 90).alias("cx"), d(s).alias("cy"), d(s).alias("radius"), F.lit("duct").alias("kind"))).alias("circles"),
        F.array(F.struct(d(s).alias("x"), d(s).alias("y"), F.lit(10.0).alias("height"), F.col("p_name").alias("content"), F.lit("Equipment Tag").alias("kind"))).alias("text"),
        F.array(F.struct(d(s * 2).alias("x"), d(s).alias("y"), F.lit("valve").alias("kind"), F.col("p_brand").alias("tag"))).alias("symbols")))
    docs = t.part.select(k.alias("doc_id"), doc.alias("doc"), F.lit(0.5).alias("scale"), F.lit(2.0).alias("origin_x"), F.lit(4.0).alias("origin_y"), F.lit(100.0).alias("height"))
    return S.explode_analysis(docs, naming.layer_for, naming.text_layer_for, naming.symbol_layer_for).select(
        "doc_id", "entity_kind", "layer", "x1", "y1", "cx", "radius", "text", "linetype")
