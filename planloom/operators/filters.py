"""Filters and predicates; all stay plain column comparisons so they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.ordered import first_n

# fixed values: category, layer and entity-type keywords per building-services domain, in matching order
DOMAINS = {
    "hvac": {
        "categories": ["mechanical equipment", "ducts", "duct fittings", "duct accessories", "air terminals", "flex ducts"],
        "layers": ["m-hvac", "m-duct", "m-equip", "mech", "hvac", "duct", "diffuser", "ahu", "vav"],
        "types": ["duct", "diffuser", "air terminal", "mechanical equipment", "vav", "ahu", "fan coil"],
    },
    "electrical": {
        "categories": ["electrical equipment", "electrical fixtures", "conduits", "cable trays", "lighting fixtures"],
        "layers": ["e-power", "e-lite", "e-equip", "elec", "electrical", "conduit", "panel", "receptacle"],
        "types": ["panel", "conduit", "receptacle", "switch", "light fixture"],
    },
    "plumbing": {
        "categories": ["plumbing fixtures", "pipes", "pipe fittings", "pipe accessories"],
        "layers": ["p-sanr", "p-dome", "p-fixt", "plumb", "plumbing", "pipe", "drain", "fixture"],
        "types": ["pipe", "fixture", "sink", "toilet", "valve"],
    },
    "fire_protection": {
        "categories": ["sprinklers", "fire alarm devices"],
        "layers": ["f-spkl", "f-alrm", "fire", "sprinkler"],
        "types": ["sprinkler", "fire alarm", "smoke detector"],
    },
    "low_voltage": {
        "categories": ["communication devices", "data devices", "fire alarm devices", "security devices",
                       "telephone devices", "nurse call devices"],
        "layers": ["lv-data", "lv-tele", "lv-sec", "lv-fa", "lv-av", "lv-bms", "lv-cctv", "lv-acc", "d-", "t-",
                   "comm", "telecom", "data", "security", "cctv"],
        "types": ["data outlet", "camera", "card reader", "smoke detector", "speaker", "access point", "patch panel",
                  "controller", "network switch", "wifi", "intercom", "pull station"],
    },
}


def any_contains(col: Column, words: list[str]) -> Column:
    """Lower-case substring test against a list of (lower-case) words."""
    test = F.lit(False)
    for w in words:
        test = test | F.contains(F.lower(col), F.lit(w))
    return F.coalesce(test, F.lit(False))


def in_bbox(df: DataFrame, x0: float, y0: float, x1: float, y1: float, x: str = "x", y: str = "y") -> DataFrame:
    return df.where(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def text_like(df: DataFrame, q: str, cols: list[str]) -> DataFrame:
    test = F.lit(False)
    for c in cols:
        test = test | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False))
    return df.where(test)


def category_contains(df: DataFrame, q: str) -> DataFrame:
    u = F.lit(q.upper())
    return df.where(F.contains(F.upper("category"), u) | F.contains(F.upper("entity_type"), u))


def domain_test(domain: str, category="category", layer="layer", etype="entity_type",
                domains: dict | None = None) -> Column:
    """Category substring, else layer substring, else exact entity type."""
    d = (domains or DOMAINS)[domain]
    return (any_contains(F.col(category), d["categories"]) | any_contains(F.col(layer), d["layers"])
            | F.coalesce(F.lower(F.col(etype)).isin(d["types"]), F.lit(False)))


def domain_of(domains: dict | None = None, **cols: str) -> Column:
    """First domain that matches (null when none does)."""
    out = None
    for name in (domains or DOMAINS):
        t = domain_test(name, domains=domains, **cols)
        out = F.when(t, F.lit(name)) if out is None else out.when(t, F.lit(name))
    return out


def in_domain(df: DataFrame, domain: str, domains: dict | None = None) -> DataFrame:
    return df.where(domain_test(domain, domains=domains))


def entities(df: DataFrame, layer: str | None, type_part: str | None, limit: int) -> tuple[DataFrame, DataFrame]:
    """Filtered rows (first ``limit`` by id) and a one-row table telling whether more exist."""
    if layer:
        df = df.where(F.lower("layer") == layer.lower())
    if type_part:
        df = df.where(F.contains(F.lower("entity_type"), F.lit(type_part.lower())))
    head = df.orderBy("id").limit(limit + 1)
    return df.orderBy("id").limit(limit), head.agg((F.count(F.lit(1)) > limit).alias("truncated"))


def resolve_reference(elements: DataFrame, refs: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Best candidate per reference text: source id, then the source id of a plain number (``007`` is 7), then the element's own
    id (the column ``uuid`` in any case of letters where elements have one, else ``id``), then the best search hit.

    ``refs``: (ref), spaces around it aside; ``hits``: (ref, id, rank). Each step is an equi-join, so no candidate list is built.
    """
    sources = elements.select(F.col("source_id").alias("_s"), "id")
    clean = refs.withColumn("_c", F.trim("ref"))
    number = F.when(F.col("_c").rlike(r"^[+-]?\d+$"), F.col("_c").try_cast("long"))
    own = F.lower("uuid") if "uuid" in elements.columns else F.col("id").cast("string")
    key = F.lower("_c") if "uuid" in elements.columns else number.cast("string")
    steps = [(F.col("_c"), sources), (number.cast("string"), sources), (key, elements.select(own.alias("_s"), "id"))]
    found = None
    for step, (ref, table) in enumerate(steps, 1):
        part = clean.select("ref", ref.alias("_s")).join(table, "_s").select("ref", "id", F.lit(step).alias("step"), F.lit(0).alias("rank"))
        found = part if found is None else found.unionByName(part)
    if hits is not None:
        found = found.unionByName(hits.select("ref", "id", F.lit(4).alias("step"), F.col("rank").cast("int").alias("rank")))
    best = found.groupBy("ref").agg(F.min(F.struct("step", "rank", "id")).alias("m"))
    return refs.join(best.select("ref", "m.id", "m.step"), "ref", "left")


def edges_contains(edges: DataFrame, containers: DataFrame | None = None) -> DataFrame:
    """``contains`` edges, with ``containers`` (id) only those that lead from one of them."""
    df = edges_of(edges, ["contains"])
    return df if containers is None else df.join(containers.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(*edges.columns)


def edges_of(edges: DataFrame, types: list[str]) -> DataFrame:
    return edges.where(F.col("relation_type").isin(types))


def recent(df: DataFrame, group: list[str], ts: str, n: int, tie: str) -> DataFrame:
    return first_n(df, group, [F.desc(ts), F.col(tie)], n)
