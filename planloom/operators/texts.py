"""Text annotations: parsing, association with elements, rooms, leaders and symbols; text classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.functions import text as T
from planloom.operators.relations import BOX, endpoints
from planloom.operators.spatial import near_pairs, nearest, overlap_pairs
from planloom.ordered import first_n
from planloom.skew import salted_join, shuffled
from planloom.staging import Stage, materialize


def parse_annotations(texts: DataFrame, patterns=T.ANNOTATION_PATTERNS) -> DataFrame:
    """Adds ``annotation_type``, ``fields`` (map), ``category`` and ``parse_source``; the first pattern decides.

    Texts that no pattern takes but that hold a room word are room names.
    """
    t = texts.withColumn("_m", T.match_pattern(T.clean_text(F.col("text")), patterns))
    kind = F.coalesce(F.col("_m.type"), F.when(T.is_room_name(F.col("text")), "room_name"), F.lit("unknown"))
    t = t.withColumns({"annotation_type": kind, "fields": F.col("_m.fields"), "parse_source": F.when(
        F.col("_m").isNotNull(), "pattern").when(T.is_room_name(F.col("text")), "keyword")}).drop("_m")
    return t.withColumn("category", F.coalesce(T.lookup(T.ANNOTATION_CATEGORY, F.col("annotation_type")), F.lit("unknown")))


def parse_stats(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("parse_source") == "pattern").alias("pattern_matched"),
                      F.count_if(F.col("annotation_type") == "unknown").alias("unknown"))


# fixed values: per annotation type the element kinds, element categories (empty = any), distance factor,
# containment and the relation it states
RULES = {
    "equipment_tag": (["symbol"], [], 2.0, False, "labels"),
    "equipment_spec": (["symbol"], [], 3.0, False, "specifies"),
    "flow_rate": (["symbol"], ["mechanical"], 2.5, False, "specifies"),
    "size": (["symbol", "geometry"], [], 2.0, False, "specifies"),
    "room_name": (["room_boundary"], [], None, True, "labels"),
    "room_number": (["room_boundary"], [], None, True, "labels"),
    "area": (["room_boundary"], [], None, True, "specifies"),
    "dimension": (["geometry"], [], 1.5, False, "dimensions"),
    "circuit_id": (["symbol"], ["electrical"], 2.0, False, "labels"),
    "panel_name": (["symbol"], ["electrical"], 3.0, False, "labels"),
}
OTHER = (["symbol", "geometry"], [], 2.0, False, "describes")


def _rule(i: int, kind: Column, typ: str, rules=RULES) -> Column:
    lit = lambda v: F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]).cast("array<string>")
    out = None
    for k, r in rules.items():
        v = lit(r[i]).cast(typ)
        out = F.when(kind == k, v) if out is None else out.when(kind == k, v)
    return out.otherwise(lit(OTHER[i]).cast(typ))


def associate_text(annotations: DataFrame, elements: DataFrame, max_distance: float = 100.0, rules=RULES) -> DataFrame:
    """Closest admissible element per parsed annotation, with relation and confidence.

    ``annotations``: (id, project_id, x, y, annotation_type, ...); ``elements``: (id, project_id, element_type,
    category, min_x..max_y). An element reaches as far as its rule factor times its size, or ``max_distance`` if that
    is more. Texts meet the elements of their rule's kinds only. The nearest one is mostly near, so elements first reach no
    farther than ``max_distance / 8``, and only texts that found nothing look on. Ties: smallest element id.
    """
    stage = Stage(annotations.sparkSession, "texts")
    kind = F.col("annotation_type")
    a = annotations.where(kind != "unknown").select(
        "id", "project_id", "x", "y", kind, F.explode(_rule(0, kind, "array<string>", rules)).alias("element_type"),
        _rule(1, kind, "array<string>", rules).alias("cats"), _rule(2, kind, "double", rules).alias("factor"),
        _rule(3, kind, "boolean", rules).alias("inside"), _rule(4, kind, "string", rules).alias("relation"))
    a = stage.write(a.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")}))
    size = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    top = max([r[2] for r in rules.values() if r[2]] + [OTHER[2]])
    # only rules with containment look at rooms, so a room box needs no reach
    wide = F.when(F.col("element_type") == "room_boundary", F.lit(0.0)).otherwise(F.greatest(size * top, F.lit(max_distance)))

    def gap(p, q):
        return geom.box_distance(p["x"], p["y"], p["x"], p["y"], q["b_min_x"], q["b_min_y"], q["b_max_x"], q["b_max_y"])

    def nearest_of(texts: DataFrame, ring: float | None) -> DataFrame:
        out = wide if ring is None else F.least(wide, F.lit(ring))
        e = elements.select("id", "project_id", "element_type", F.col("category").alias("cat"), *[F.col(c).alias(f"b_{c}") for c in BOX],
                            size.alias("size"), (F.col("min_x") - out).alias("min_x"), (F.col("min_y") - out).alias("min_y"),
                            (F.col("max_x") + out).alias("max_x"), (F.col("max_y") + out).alias("max_y"))

        def fits(p, q):
            reach = F.when(p["inside"], F.lit(0.0)).otherwise(F.greatest(p["factor"] * q["size"], F.lit(max_distance)))
            return ((F.size(p["cats"]) == 0) | F.array_contains(p["cats"], q["cat"])) & (gap(p, q) <= (reach if ring is None else F.least(reach, F.lit(ring))))

        pairs = overlap_pairs(texts, e, BOX, on=["project_id", "element_type"], where=fits)
        d = pairs.select("a", "b", gap(F.col("a"), F.col("b")).alias("distance"))
        return d.groupBy(F.col("a.id").alias("annotation_id")).agg(F.min_by(
            F.struct(F.col("a.project_id"), F.col("a.annotation_type"), F.col("a.relation"), F.col("b.id").alias("element_id"),
                     F.col("b.element_type"), F.col("b.size"), "distance"), F.struct("distance", F.col("b.id"))).alias("m"))

    near = stage.write(nearest_of(a, max_distance / 8))
    rest = a.where(~F.col("inside")).join(shuffled(near.select(F.col("annotation_id").alias("id"))), "id", "left_anti")
    best = near.unionByName(nearest_of(rest, None))
    conf = F.when(F.col("distance") == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), 1.0 - F.col("distance") / (3.0 * F.greatest(F.col("size"), F.lit(1.0)))))
    return best.select("annotation_id", "m.*").withColumn("confidence", conf).drop("size")


SPEC_TYPES = ["equipment_spec", "size", "flow_rate", "power", "capacity"]


def annotations_by_element(links: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags per element as rows (element, tag) and merged specifications as rows (element, field, value).

    Of several values for a field the one from the last annotation (by id) wins. Rows, not lists, so an element
    with very many texts stays spread out.
    """
    j = links.select("element_type", "element_id", F.col("annotation_id").alias("id")).join(
        shuffled(annotations.select("id", "text", "annotation_type", "fields")), "id")
    tags = j.where("annotation_type = 'equipment_tag'").select("element_type", "element_id", F.col("text").alias("tag"))
    f = j.where(F.col("annotation_type").isin(SPEC_TYPES)).select("element_type", "element_id", "id", F.explode("fields").alias("field", "value"))
    return tags, f.groupBy("element_type", "element_id", "field").agg(F.max_by("value", "id").alias("value"))


def room_annotations(annotations: DataFrame, rooms: DataFrame) -> DataFrame:
    """Name, number and areas per room from the texts inside it; a text counts for its first room (by id)."""
    a = annotations.where(F.col("annotation_type").isin("room_name", "room_number", "area")).select(
        "id", "project_id", "x", "y", "text", "annotation_type", "fields")
    p = a.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")})
    hit = overlap_pairs(p, rooms.select("id", "project_id", *BOX), BOX, on=["project_id"])
    one = hit.groupBy(F.col("a.id").alias("id")).agg(F.min("b.id").alias("room_id"), F.first("a").alias("a"))
    last = lambda kind, v: F.max_by(F.when(F.col("a.annotation_type") == kind, v), F.when(
        (F.col("a.annotation_type") == kind) & v.isNotNull(), F.col("id")))
    field = lambda n: F.try_element_at("a.fields", F.lit(n))
    info = one.groupBy("room_id").agg(
        last("room_name", F.col("a.text")).alias("name"),
        last("room_number", F.coalesce(field("room_number"), F.col("a.text"))).alias("number"),
        last("area", field("area_sf").try_cast("double")).alias("area_sf"),
        last("area", field("area_m2").try_cast("double")).alias("area_m2"), F.count(F.lit(1)).alias("n_texts"))
    return rooms.select(F.col("id").alias("room_id")).join(info, "room_id", "left").withColumn(
        "n_texts", F.coalesce("n_texts", F.lit(0)))


def leader_targets(leaders: DataFrame, symbols: DataFrame, annotations: DataFrame, max_distance: float = 20.0) -> DataFrame:
    """Text at one end of each leader and symbol at the other end, both the nearest within ``max_distance``."""
    ends = endpoints(leaders.select("id", "project_id", "x1", "y1", "x2", "y2"))
    texts = annotations.select("id", "project_id", "x", "y")
    near = near_pairs(ends, texts, max_distance, on=["project_id"], strict=True)
    # nearest text over both ends; at equal distance the end point (1) is the text end
    best = near.groupBy(F.col("a.id").alias("leader_id")).agg(F.min(F.struct(
        "distance", F.col("b.id").alias("text_id"), (-F.col("a.end_no")).alias("neg"))).alias("m"))
    far = best.select("leader_id", "m.text_id", (F.lit(1) + F.col("m.neg")).alias("end_no"))
    other = ends.select(F.col("id").alias("leader_id"), "project_id", "end_no", "x", "y").join(far, ["leader_id", "end_no"])
    hit = nearest(other, symbols.select("id", "project_id", "x", "y"), max_distance, on=["project_id"], lid="leader_id")
    return hit.select(F.col("a.leader_id").alias("leader_id"), F.col("a.text_id").alias("text_id"), F.col("b.id").alias("symbol_id"))


def nearby_text(symbols: DataFrame, annotations: DataFrame, radius: float, n: int) -> DataFrame:
    """The ``n`` closest texts of every symbol within ``radius``."""
    p = near_pairs(symbols.select("id", "project_id", "x", "y"), annotations.select("id", "project_id", "x", "y", "text"),
                   radius, on=["project_id"])
    rows = p.select(F.col("a.id").alias("symbol_id"), F.col("b.id").alias("text_id"), F.col("b.text").alias("text"), "distance")
    return first_n(rows, ["symbol_id"], [F.col("distance"), F.col("text_id")], n)


def enrich_symbols(detected: DataFrame, semantic: DataFrame, tolerance: float = 50.0) -> DataFrame:
    """First semantic symbol (by id) within ``tolerance`` gives its attributes to the detected one."""
    p = near_pairs(detected.select("id", "project_id", "x", "y"), semantic.select("id", "project_id", "x", "y", "tag", "size"),
                   tolerance, on=["project_id"], strict=True)
    best = p.groupBy(F.col("a.id").alias("id")).agg(F.min_by(F.struct("b.tag", "b.size", F.col("b.id").alias("match_id")), "b.id").alias("m"))
    attrs = F.map_filter(F.create_map(F.lit("TAG"), F.col("m.tag"), F.lit("SIZE"), F.col("m.size")), lambda k, v: v.isNotNull() & (v != ""))
    return detected.join(best, "id", "left").select(*detected.columns, F.col("m.match_id").alias("match_id"), attrs.alias("attributes"))


# -- text classification (T8, T9, T10) ------------------------------------------------------------------

# fixed values: words per drawing type; a word counts with its length
DRAWING_TYPES = {
    "floor_plan": ["floor plan", "floorplan", "architectural", "arch plan", "a-", "a1", "a2", "a3", "a100", "a101", "a200"],
    "electrical_plan": ["electrical", "power plan", "lighting plan", "elec", "e-", "e1", "e2", "e100", "e101", "e200", "panel",
                        "circuit", "outlet", "receptacle"],
    "hvac_plan": ["hvac", "mechanical", "mech", "ductwork", "duct plan", "m-", "m1", "m2", "m100", "m101", "m200", "diffuser",
                  "vav", "ahu", "cfm"],
    "plumbing_plan": ["plumbing", "plumb", "piping", "p-", "p1", "p2", "p100", "p101", "p200", "fixture", "drain", "waste",
                      "vent", "dwv"],
    "fire_alarm": ["fire alarm", "fa plan", "fire detection", "fa-", "fa1", "fa2", "smoke detector", "pull station", "facp",
                   "horn strobe"],
    "fire_protection": ["fire protection", "sprinkler", "fp plan", "fp-", "fp1", "fp2", "standpipe", "fire pump", "sprinkler head"],
    "single_line": ["single line", "single-line", "one line", "one-line", "riser diagram", "power riser"],
    "riser_diagram": ["riser", "vertical diagram", "stack diagram"],
    "mep_plan": ["mep", "m/e/p", "combined"],
    "detail": ["detail", "section", "elevation", "typ"],
    "schedule": ["schedule", "equipment list", "fixture list", "door schedule", "room schedule", "panel schedule"],
    "legend": ["legend", "symbols", "abbreviations", "notes"],
    "site_plan": ["site plan", "civil", "grading", "survey", "c-", "c1", "c100"],
    "structural": ["structural", "framing", "foundation", "s-", "s1", "s100", "s200"],
}


def classify_documents(docs: DataFrame, text: str = "text", table: dict[str, list[str]] | None = None) -> DataFrame:
    """Drawing type with the highest sum of matched word lengths; confidence min(0.8, score / 50)."""
    t = {k: [(w, len(w)) for w in v] for k, v in (table or DRAWING_TYPES).items()}
    d = docs.withColumn("_s", F.array_max(T.keyword_scores(F.lower(text), t)))
    hit = F.col("_s.score") > 0
    return d.withColumns({
        "drawing_type": F.when(hit, F.col("_s.label")).otherwise("unknown"), "score": F.col("_s.score"),
        "confidence": F.when(hit, F.least(F.lit(0.8), F.col("_s.score") / 50.0)).otherwise(F.lit(0.0))}).drop("_s")


#: A word, or what stands between two words.
TOKEN = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_]+)"


def word_runs(text: Column, longest: int) -> Column:
    """The distinct runs of 1 to ``longest`` words of a text, each with what stands between its words."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    starts = F.filter(F.transform(tokens, lambda t, i: F.when(t.rlike(r"^[\p{L}\p{N}_]"), i + 1)), lambda i: i.isNotNull())

    def of(k: int) -> Column:
        return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(2 * k - 1)), ""))

    return F.array_distinct(F.concat(*map(of, range(1, longest + 1))))


def pattern_table(spark: SparkSession, patterns: list[tuple[str, str, float, str | None]]) -> DataFrame:
    rows = [(i, d, w, float(wt), s) for i, (d, w, wt, s) in enumerate(patterns)]
    return spark.createDataFrame(rows, "no int, domain string, words string, weight double, subdomain string")


def score_domains(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, domain, subdomain, score, all_scores) of the texts (key, text in lower case) that some pattern matches.

    Texts are listed by their runs of words and meet the pattern table (no, domain, words, weight, subdomain) in one join, so
    the cost does not grow with the number of patterns. Only the numbers of a text's patterns are shuffled, once for equal texts
    of equal keys, unless the table is too large to be sent to the tasks. ``words`` begin and end with a letter, digit or underscore and match
    whole words only. Of equal scores the domain that comes first in the table wins, of equal weights the first pattern.
    """
    longest = patterns.agg(F.max(F.ceil(F.size(F.regexp_extract_all("words", F.lit(TOKEN), F.lit(1))) / 2))).first()[0] or 1
    first = patterns.groupBy("domain").agg(F.min("no").alias("domain_no"))
    table = patterns.join(first, "domain").select(F.lower("words").alias("run"), "domain", "domain_no", "no", "weight", "subdomain")
    # written, so that its true size decides on a broadcast; rows made on the driver have none
    table = materialize(table, "patterns")
    hits = texts.select("key", F.explode(word_runs(F.col("text"), int(longest))).alias("run")).join(table.select("run", "no"), "run").select("key", "no").distinct()
    by_domain = hits.join(table.drop("run"), "no").groupBy("key", "domain", "domain_no").agg(F.sum("weight").alias("score"), F.max_by(F.struct("subdomain"), F.struct("weight", -F.col("no"))).alias("s"))
    best = F.max_by(F.struct("domain", "s.subdomain", "score"), F.struct("score", -F.col("domain_no"))).alias("b")
    return by_domain.groupBy("key").agg(best, F.sum("score").alias("all_scores")).select("key", "b.*", "all_scores")


def classify_intent(msgs: DataFrame, patterns: DataFrame | list[tuple[str, str, float, str | None]], actions: dict[str, list[str]],
                    apps: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Domain, subdomain, action and program a sentence is about.

    ``patterns``: a table (see ``score_domains``) of any size, or a list of (domain, words, weight, subdomain); the domain with
    the largest summed weight wins, its heaviest match names the subdomain. Equal texts have one key. Actions and programs
    count contained words, before the join, so that it needs no text that the caller drops. A null text is about nothing.
    """
    if isinstance(patterns, list):
        patterns = pattern_table(msgs.sparkSession, patterns)
    low = F.col("_low")
    count = lambda ws: sum((F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in ws), F.lit(0))
    (n1, w1), (n2, w2) = apps.items()
    # columns of their own, so that each is reckoned once for a row
    placed = msgs.withColumn("_low", F.lower(text))
    placed = placed.withColumns({"_key": F.md5(F.coalesce(low, F.lit(""))), "_c1": count(w1), "_c2": count(w2),
                                 "_act": F.array_max(T.keyword_scores(low, {k: [(w, 1.0) for w in v] for k, v in actions.items()}))}).drop("_low")
    texts = msgs.select(F.lower(text).alias("text")).where("text is not null").select(F.md5("text").alias("key"), "text")
    scored = score_domains(texts, patterns).select(F.col("key").alias("_key"), F.struct("domain", "subdomain", "score", "all_scores").alias("_b"))
    m = salted_join(placed, scored, ["_key"], how="left")
    any_hit, act, c1, c2 = F.coalesce(F.col("_b.score") > 0, F.lit(False)), F.col("_act"), F.col("_c1"), F.col("_c2")
    return m.withColumns({
        "domain": F.when(any_hit, F.col("_b.domain")).otherwise("general"),
        "subdomain": F.when(any_hit, F.col("_b.subdomain")),
        "confidence": F.when(any_hit, F.least(F.lit(1.0), F.col("_b.score") / 6.0) * 0.6 + F.col("_b.score") / F.col("_b.all_scores") * 0.4)
        .otherwise(F.lit(0.0)),
        "action": F.when(act["score"] > 0, act["label"]).otherwise("query"),
        "app": F.when((c1 >= 2) & (c1 > c2 * 2), n1).when((c2 >= 2) & (c2 > c1 * 2), n2).otherwise("both")}).drop("_b", "_key", "_act", "_c1", "_c2")


# fixed values: words per conversion profile
PROFILES = {
    "architectural": ["floor plan", "elevation", "section", "architectural", "room", "door", "window", "wall", "corridor", "restroom"],
    "mechanical": ["mechanical", "machine", "part", "assembly", "shaft", "bearing", "thread", "tolerance", "detail"],
    "electrical": ["electrical", "schematic", "wiring", "circuit", "panel", "outlet", "switch", "transformer", "motor"],
    "structural": ["structural", "beam", "column", "footing", "foundation", "rebar", "concrete", "steel", "framing"],
    "civil": ["civil", "site", "grading", "contour", "property", "easement", "survey", "topographic"],
    "hvac": ["hvac", "duct", "mechanical", "air handling", "diffuser", "vav", "ahu", "cfm", "ventilation"],
    "plumbing": ["plumbing", "pipe", "sanitary", "drainage", "fixture", "water", "riser", "isometric"],
    "fire_alarm": ["fire alarm", "smoke detector", "pull station", "facp", "notification", "horn", "strobe", "fa"],
}


def detect_profile(docs: DataFrame, filename: str, text: str, drawing_type: str,
                   table: dict[str, list[str]] | None = None) -> DataFrame:
    """Profile by word counts in file name and text, with the drawing type counting three times."""
    t = {k: [(w, 1.0) for w in v] for k, v in (table or PROFILES).items()}
    parts = [T.keyword_scores(F.lower(F.coalesce(F.col(c), F.lit(""))), t) for c in (filename, text, drawing_type)]
    both = F.zip_with(parts[0], parts[1], lambda a, b: F.struct((a["score"] + b["score"]).alias("score"), a["neg"].alias("neg"), a["label"].alias("label")))
    full = F.zip_with(both, parts[2], lambda a, b: F.struct((a["score"] + b["score"] * 3.0).alias("score"), a["neg"].alias("neg"), a["label"].alias("label")))
    d = docs.withColumn("_b", F.array_max(full))
    return d.withColumns({"profile": F.when(F.col("_b.score") > 0, F.col("_b.label")).otherwise("general"),
                          "profile_score": F.col("_b.score")}).drop("_b")
