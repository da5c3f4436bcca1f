"""Rule tables joined with elements, and the design checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.operators.filters import any_contains
from planloom.operators.spatial import near_pairs
from planloom.skew import salted_join
from planloom.staging import Stage

RULE_SCHEMA = """rule_name string, rule_type string, subdomain string, element_types array<string>, near_types array<string>,
 priority int, min_distance double, max_velocity double, min_flow double, min_slope double, min_clearance double, severity string"""


def rule_table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A literal rule table (missing fields are null). Its size is that of the literal list."""
    names = [c.split()[0] for c in RULE_SCHEMA.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], RULE_SCHEMA)


#: Stands for a condition that a context says nothing about.
ABSENT = "\x00"


def match_contexts(contexts: DataFrame, rules: DataFrame, stage: Stage) -> DataFrame:
    """(context, rule): the rules whose every condition holds in a context, or is one the context says nothing about.

    ``contexts``: (context, facts map<string, array<string>>); ``rules``: (rule, conditions map<string, array<string>>). A
    condition holds if one of the context's values is among the rule's. Counting match over an inverted index: rules are
    listed by (key, value), contexts too, with a mark for each key that only rules know; they meet in one equi-join and a
    rule applies if as many of its keys are hit as it has. Rules without conditions are listed under a key that every context
    has, once there is such a rule.
    """
    rules = stage.write(rules.select("rule", F.coalesce("conditions", F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")).alias("conditions")))
    # the names of conditions: as many as the attributes that rules are written for
    keys = sorted(r[0] for r in rules.select(F.explode(F.map_keys("conditions"))).distinct().collect())
    free = not rules.where(F.size("conditions") == 0).isEmpty()
    flat = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.map_entries(c), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.alias("value")))))))
    listed = rules.select("rule", F.greatest(F.size("conditions"), F.lit(1)).alias("needs"), F.when(F.size("conditions") == 0, F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value")))).otherwise(
        F.concat(F.flatten(F.transform(F.map_entries("conditions"), lambda e: F.transform(e["value"], lambda v: F.struct(e["key"].alias("key"), v.alias("value"))))),
                 F.transform(F.map_keys("conditions"), lambda k: F.struct(k.alias("key"), F.lit(ABSENT).alias("value"))))).alias("p"))
    index = listed.select("rule", "needs", F.explode(F.array_distinct("p")).alias("p")).select("rule", "needs", "p.key", "p.value")
    known = F.map_filter(F.coalesce("facts", F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")), lambda k, v: v.isNotNull())
    missing = F.transform(F.array_except(F.array(*map(F.lit, keys)).cast("array<string>"), F.map_keys("known")), lambda k: F.struct(k.alias("key"), F.lit(ABSENT).alias("value")))
    always = F.array(F.struct(F.lit("").alias("key"), F.lit("").alias("value"))) if free else F.array().cast("array<struct<key:string,value:string>>")
    said = contexts.select("context", known.alias("known")).withColumn("more", F.concat(missing, always))
    said = said.select("context", flat("known").alias("p")).unionByName(said.select("context", F.explode("more").alias("p"))).select("context", "p.key", "p.value")
    hits = salted_join(stage.write(said), index, ["key", "value"]).groupBy("context", "rule").agg(F.count_distinct("key").alias("n"), F.first("needs").alias("needs"))
    return hits.where("n = needs").select("context", "rule")


def _facts(columns: dict[str, Column], more: Column | None) -> Column:
    own = F.map_filter(F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return own if more is None else F.map_concat(own, F.coalesce(more, F.map_from_arrays(F.array(), F.array()).cast("map<string,array<string>>")))


def applicable_rules(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """(element columns, rule columns) where every condition present on both sides matches.

    An element's context is its ``element_type``, ``element_subdomain``, ``near_elements`` (array) where it has these, and
    whatever the map ``context`` (map<string, array<string>>) says, such as action or space type; null means that nothing is
    known. A rule's conditions are ``element_types``, ``subdomain``, ``near_types`` where elements know their neighbours,
    and the map ``conditions``. Elements of the same context are matched once. Columns of both must not clash.
    """
    stage = Stage(elements.sparkSession, "rules")
    has = lambda df, c: c in df.columns
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c)))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    own = {"element_type": one("element_type"), "subdomain": one("element_subdomain")} | ({"near": F.col("near_elements")} if has(elements, "near_elements") else {})
    need = {"element_type": some("element_types"), "subdomain": one("subdomain")} | ({"near": some("near_types")} if has(elements, "near_elements") else {})
    placed = elements.withColumn("_facts", _facts(own, F.col("context") if has(elements, "context") else None))
    ordered = F.array_sort(F.transform(F.map_entries("_facts"), lambda e: F.struct(e["key"].alias("key"), F.array_sort(e["value"]).alias("value"))))
    placed = placed.withColumn("_context", F.to_json(ordered))
    known = stage.write(rules.withColumn("_rule", F.monotonically_increasing_id()))
    asked = known.select(F.col("_rule").alias("rule"), _facts(need, F.col("conditions") if has(rules, "conditions") else None).alias("conditions"))
    contexts = placed.groupBy(F.col("_context").alias("context")).agg(F.first("_facts").alias("facts"))
    matched = stage.write(match_contexts(contexts, asked, stage))
    found = matched.join(known, F.col("rule") == F.col("_rule")).drop("rule", "_rule").withColumnRenamed("context", "_context")
    return salted_join(placed.drop("_facts"), found, ["_context"]).drop("_context")


def clearance_rules(rules: DataFrame, element_type: str | None = None, near_type: str | None = None) -> DataFrame:
    """Clearance rules whose type lists hold the given types; an empty list holds all."""
    df = rules.where("rule_type = 'clearance'")
    for col, v in (("element_types", element_type), ("near_types", near_type)):
        if v:
            df = df.where(F.col(col).isNull() | (F.size(col) == 0) | F.array_contains(col, v))
    return df


def check_status(has: dict[str, Column] | None = None) -> Column:
    """Status of one rule on one element row; null = nothing to report."""
    h = has or {c: F.col(c) for c in ("clearance", "velocity", "flow", "slope", "access_clearance")}
    below = lambda v, lim: v.isNotNull() & F.col(lim).isNotNull() & (F.col(lim) != 0) & (v < F.col(lim))
    return (F.when((F.col("rule_type") == "clearance") & h["clearance"].isNotNull(),
                   F.when(h["clearance"] < F.coalesce("min_distance", F.lit(0.0)), "error").otherwise("pass"))
            .when((F.col("rule_type") == "sizing") & (h["velocity"] > F.col("max_velocity")),
                  F.when(F.col("severity") == "warning", "warning").otherwise("error"))
            .when((F.col("rule_type") == "sizing") & below(h["flow"], "min_flow") & (h["flow"] != 0), "warning")
            .when((F.col("rule_type") == "routing") & below(h["slope"], "min_slope"), "error")
            .when((F.col("rule_type") == "access") & below(h["access_clearance"], "min_clearance"), "warning"))


def validate(elements: DataFrame, rules: DataFrame) -> DataFrame:
    """One row per check with a result. Rules match exactly first, then by substring of the category."""
    pairs = applicable_rules(elements, rules)
    in_category = F.col("element_types").isNull() | (F.size("element_types") == 0) | F.exists(
        "element_types", lambda t: F.contains(F.lower("category"), F.lower(t)))
    return pairs.where(in_category).withColumn("status", check_status()).where("status is not null")


def validation_summary(results: DataFrame, keys: list[str], details: int = 20) -> DataFrame:
    """Totals by status and the first failures (by element and rule) as text."""
    from planloom.ordered import first_n

    totals = results.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"), *[
        F.count_if(F.col("status") == s).alias(s) for s in ("pass", "warning", "error")])
    top = first_n(results.where("status <> 'pass'"), keys, [F.col("id"), F.col("rule_name")], details)
    text = top.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "id", "rule_name"))), lambda r: F.concat_ws(":", r["id"], r["rule_name"])), ",").alias("details"))
    return totals.join(text, keys, "left")


def suggest(elements: DataFrame) -> DataFrame:
    """Design suggestions (type, priority) per element."""
    duct = F.contains(F.lower("category"), F.lit("duct"))
    equip = F.contains(F.lower("category"), F.lit("equipment")) | F.contains(F.lower("category"), F.lit("ahu"))
    s = lambda test, kind, why, prio: F.when(test, F.struct(
        F.lit(kind).alias("suggestion_type"), F.lit(why).alias("reason"), F.lit(prio).alias("priority")))
    v = F.col("velocity")
    found = F.array_compact(F.array(
        s(duct & (v > 1500), "sizing", "high velocity", 60), s(duct & (v > 0) & (v < 400), "sizing", "oversized", 40),
        s(equip & F.col("access_clearance").isNull(), "access", "service access", 70),
        s(F.col("near_structure"), "routing", "parallel to structure", 50)))
    return elements.select("id", F.explode(found).alias("s")).select("id", "s.*")


# fixed values: required clearance in metres between two element types
CLEARANCES = [
    ("duct", "beam", 0.15), ("duct", "column", 0.10), ("duct", "slab", 0.10), ("supply_duct", "supply_duct", 0.05),
    ("supply_duct", "return_duct", 0.05), ("pipe", "beam", 0.10), ("pipe", "column", 0.05), ("conduit", "pipe", 0.15),
    ("conduit", "duct", 0.05), ("ahu", "wall", 0.45), ("vav", "ceiling", 0.30), ("sprinkler", "obstruction", 0.45),
]
DEFAULT_CLEARANCE = 0.10


def clearance_pairs(elements: DataFrame, clearances: list[tuple[str, str, float]] = CLEARANCES,
                    radius: float = 2.0, default: float = DEFAULT_CLEARANCE) -> DataFrame:
    """Pairs closer than the clearance of their two categories (either order); error below half of it.

    No pair farther apart than the largest clearance can fail, so that bounds the join as well as ``radius``.
    """
    table = {}
    for a, b, v in reversed(clearances):
        table[f"{a}|{b}"] = v
    m = F.create_map(*[F.lit(v) for kv in table.items() for v in kv])
    reach = min(radius, max([default, *[v for _, _, v in clearances]]))
    rows = elements.select("id", "project_id", "x", "y", "z", F.lower("category").alias("category"))
    pair = near_pairs(rows, rows, reach, ("x", "y", "z"), on=["project_id"], where=lambda a, b: a["id"] < b["id"])
    k = lambda p, q: m[F.concat_ws("|", F.col(f"{p}.category"), F.col(f"{q}.category"))]
    need = F.coalesce(k("a", "b"), k("b", "a"), F.lit(default))
    return pair.select(F.col("a.project_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance",
                       need.alias("required")).where("distance < required").withColumn(
        "severity", F.when(F.col("distance") < F.col("required") * 0.5, "error").otherwise("warning"))


# fixed values: velocity limits (min, max, recommended) and the factor per kind of space
VELOCITY = {
    "supply_main": (1000, 4000, 2500), "supply_branch": (600, 2000, 1200), "return_main": (1000, 4500, 3000),
    "return_branch": (600, 2400, 1400), "exhaust": (800, 3000, 2000), "cold_water": (2, 8, 5), "hot_water": (2, 5, 4),
    "chilled_water": (3, 10, 6), "condenser_water": (4, 12, 8), "steam": (60, 120, 80),
}
SPACE_FACTOR = {"office": 0.7, "lobby": 0.6, "conference": 0.5, "mechanical": 1.2}
# fixed values: least slope in percent per kind of drain
MIN_SLOPE = {"condensate": 1.0, "gravity_drain": 2.0, "storm_drain": 1.0, "sanitary": 2.0, "vent": 0.0}
# fixed values: floor area per device
COVERAGE = {"diffuser_linear": 150, "diffuser_square": 200, "diffuser_round": 175,
            "sprinkler_light": 225, "sprinkler_ordinary": 130, "sprinkler_extra": 100}
MAX_SPACING_FT = 15.0
FEET = 3.281


def _lookup(table: dict[str, float], key: Column) -> Column:
    return F.create_map(*[F.lit(v) for kv in table.items() for v in (kv[0], float(kv[1]))])[key]


def _has(word: str, *cols: Column) -> Column:
    t = F.lit(False)
    for c in cols:
        t = t | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
    return t


def classify_duct(name: Column, system: Column) -> Column:
    main = any_contains(name, ["main", "trunk", "riser"])
    return (F.when(_has("supply", name, system), F.when(main, "supply_main").otherwise("supply_branch"))
            .when(_has("return", name, system), F.when(main, "return_main").otherwise("return_branch"))
            .when(_has("exhaust", name, system), "exhaust").otherwise("supply_branch"))


def classify_pipe(name: Column, system: Column) -> Column:
    return (F.when(_has("hot", name, system) | _has("hwp", system), "hot_water")
            .when(_has("chill", name) | _has("chw", system), "chilled_water")
            .when(_has("condenser", name) | _has("cw", system), "condenser_water")
            .when(_has("steam", name, system), "steam").otherwise("cold_water"))


def classify_drain(name: Column, system: Column) -> Column:
    return (F.when(_has("condensate", name, system), "condensate").when(_has("storm", name, system), "storm_drain")
            .when(_has("sanitary", name, system), "sanitary").when(_has("vent", name, system), "vent").otherwise("gravity_drain"))


# fixed values: keywords per services discipline, in matching order
SUBDOMAINS = {
    "hvac": ["duct", "diffuser", "vav", "ahu", "hvac", "air", "damper", "fan"],
    "electrical": ["conduit", "panel", "circuit", "cable", "receptacle", "switch"],
    "plumbing": ["pipe", "fixture", "drain", "valve", "plumbing", "water"],
    "fire_protection": ["sprinkler", "standpipe", "fire", "alarm", "detector"],
}


def infer_subdomain(category: Column) -> Column:
    out = None
    for name, words in SUBDOMAINS.items():
        t = any_contains(category, words)
        out = F.when(t, name) if out is None else out.when(t, name)
    return out.otherwise("mep")


def duct_velocity(ducts: DataFrame) -> DataFrame:
    """``ducts``: (id, name, system, velocity, cfm, area, space_type). Velocity is given or cfm / area."""
    v = F.coalesce("velocity", F.when((F.col("area") > 0) & (F.col("cfm") != 0), F.col("cfm") / F.col("area")))
    kind = classify_duct(F.col("name"), F.col("system"))
    lim = lambda i: _lookup({k: t[i] for k, t in VELOCITY.items()}, F.col("kind"))
    factor = F.coalesce(_lookup(SPACE_FACTOR, F.lower("space_type")), F.lit(1.0))
    d = ducts.select("id", v.alias("v"), kind.alias("kind"), "space_type").where("v is not null")
    d = d.withColumn("max_v", lim(1) * factor)
    sev = F.when(F.col("v") > F.col("max_v"), F.when(F.col("v") < F.col("max_v") * 1.2, "warning").otherwise("error")).when(
        F.col("v") < lim(0), "info")
    return d.withColumn("severity", sev).where("severity is not null").select("id", "kind", "v", "max_v", "severity")


def pipe_velocity(pipes: DataFrame) -> DataFrame:
    """``pipes``: (id, name, system, velocity, gpm, diameter); velocity is given or 0.4085 gpm / d²."""
    d2 = F.col("diameter") * F.col("diameter")
    v = F.coalesce("velocity", F.when((F.col("diameter") > 0) & (F.col("gpm") != 0), 0.4085 * F.col("gpm") / d2))
    p = pipes.select("id", v.alias("v"), classify_pipe(F.col("name"), F.col("system")).alias("kind")).where("v is not null")
    p = p.withColumn("max_v", _lookup({k: t[1] for k, t in VELOCITY.items()}, F.col("kind")))
    return p.where("v > max_v").withColumn("severity", F.when(F.col("v") < F.col("max_v") * 1.2, "warning").otherwise("error"))


def slope(drains: DataFrame) -> DataFrame:
    """``drains``: (id, name, system, slope, x1, y1, z1, x2, y2, z2); slope is given or rise over run in percent."""
    run = F.hypot(F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2"))
    s = F.coalesce("slope", F.when(run > 0, F.abs((F.col("z2") - F.col("z1")) / run) * 100.0))
    d = drains.select("id", s.alias("s"), classify_drain(F.col("name"), F.col("system")).alias("kind")).where("s is not null")
    return d.withColumn("min_slope", _lookup(MIN_SLOPE, F.col("kind"))).where("s < min_slope")


def offset(elements: DataFrame, max_angle: float = 45.0) -> DataFrame:
    return elements.where(F.col("offset_angle") > max_angle)


def coverage(rooms: DataFrame, devices: DataFrame, per_device: Column, severity: str) -> DataFrame:
    """Rooms (room_id, area) whose area per device exceeds ``per_device``; a room without a device is an error."""
    n = devices.groupBy("room_id").agg(F.count(F.lit(1)).alias("devices"))
    r = rooms.join(n, "room_id", "left").withColumn("devices", F.coalesce("devices", F.lit(0))).withColumn("limit_area", per_device)
    sev = F.when(F.col("devices") == 0, "error").when(F.col("area") / F.col("devices") > F.col("limit_area"), severity)
    return r.withColumn("severity", sev).where("severity is not null").select(
        "room_id", "area", "devices", "severity",
        F.when(F.col("devices") > 0, F.ceil(F.col("area") / F.col("limit_area"))).alias("recommended"))


def diffuser_spacing(diffusers: DataFrame, max_ft: float = MAX_SPACING_FT) -> DataFrame:
    """Per diffuser the number of others in its room that are farther away than the limit.

    The far pairs are counted as all others minus those within the limit, so only near pairs are made.
    """
    rows = diffusers.select("id", "room_id", "x", "y")
    r = max_ft / FEET
    close = near_pairs(rows, rows, r, on=["room_id"], where=lambda a, b: a["id"] != b["id"]).where(
        F.col("distance") * FEET <= max_ft).groupBy(F.col("a.id").alias("id")).agg(F.count(F.lit(1)).alias("near"))
    total = rows.groupBy("room_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.join(total, "room_id").join(close, "id", "left").select(
        "room_id", "id", (F.col("n") - 1 - F.coalesce("near", F.lit(0))).alias("far")).where("far > 0")
