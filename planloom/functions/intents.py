"""A starter pattern table for ``classify_intent``; larger tables are passed as a parameter."""

# fixed values: (domain, words, weight, subdomain)
PATTERNS = [
    ("hvac", "ahu", 3.0, "equipment"), ("hvac", "air handler", 3.0, "equipment"), ("hvac", "vav", 3.0, "equipment"),
    ("hvac", "chiller", 3.0, "equipment"), ("hvac", "boiler", 3.0, "equipment"), ("hvac", "heat pump", 2.5, "equipment"),
    ("hvac", "duct", 2.5, "distribution"), ("hvac", "supply air", 2.5, "distribution"), ("hvac", "return air", 2.5, "distribution"),
    ("hvac", "diffuser", 3.0, "terminals"), ("hvac", "grille", 2.5, "terminals"), ("hvac", "thermostat", 2.5, "controls"),
    ("hvac", "damper", 2.5, "controls"), ("hvac", "cfm", 3.0, "parameters"), ("hvac", "velocity", 2.0, "parameters"),
    ("hvac", "elbow", 2.0, "fittings"), ("hvac", "hvac", 3.0, None), ("hvac", "cooling", 2.0, None),
    ("electrical", "panel", 2.5, "equipment"), ("electrical", "transformer", 3.0, "equipment"),
    ("electrical", "conduit", 3.0, "distribution"), ("electrical", "circuit", 2.5, "distribution"),
    ("electrical", "receptacle", 3.0, "devices"), ("electrical", "outlet", 2.5, "devices"), ("electrical", "switch", 2.0, "devices"),
    ("electrical", "voltage", 2.5, "parameters"), ("electrical", "electrical", 2.5, None), ("electrical", "power", 1.5, None),
    ("plumbing", "water heater", 3.0, "equipment"), ("plumbing", "pipe", 2.0, "distribution"), ("plumbing", "drain", 2.5, "distribution"),
    ("plumbing", "sink", 2.5, "fixtures"), ("plumbing", "fixture", 2.5, "fixtures"), ("plumbing", "gpm", 3.0, "parameters"),
    ("plumbing", "valve", 2.0, "fittings"), ("plumbing", "elbow", 2.0, "fittings"), ("plumbing", "plumbing", 3.0, None),
    ("fire_protection", "fire pump", 3.0, "equipment"), ("fire_protection", "sprinkler", 3.0, "distribution"),
    ("fire_protection", "fire alarm", 3.0, "devices"), ("fire_protection", "smoke detector", 3.0, "devices"),
    ("low_voltage", "card reader", 3.0, "security"), ("low_voltage", "camera", 2.5, "security"),
    ("low_voltage", "data outlet", 3.0, "data"), ("low_voltage", "speaker", 2.5, "av"), ("low_voltage", "controller", 2.0, "bms"),
]
# fixed values: words per action
ACTIONS = {
    "query": ["find", "list", "show", "get", "what", "where", "which", "search", "locate", "identify", "display", "look for", "how many"],
    "create": ["draw", "create", "add", "place", "insert", "make", "new", "generate", "build", "vectorize", "trace", "convert to cad", "convert to dwg",
               "import", "digitize"],
    "modify": ["edit", "change", "update", "modify", "move", "resize", "adjust", "relocate", "rename", "set"],
    "delete": ["delete", "remove", "erase", "clear"],
    "analyze": ["check", "validate", "verify", "analyze", "report", "review", "inspect", "audit", "assess"],
    "route": ["route", "connect", "run", "path", "routing", "trace"],
    "schedule": ["schedule", "count", "tally", "summarize", "tabulate", "list all"],
    "coordinate": ["clash", "conflict", "coordinate", "interference", "collision", "overlapping"],
}
# fixed values: words per program
APPS = {
    "autocad": ["autocad", "acad", "dwg", "drawing", "layer", "polyline", "block", "xref", "entity", "handle", "model space", "paper space", "vectorize",
                "raster", "scan", "scanned", "tiff", "tif", "pdf", "image to cad", "convert to cad", "trace", "digitize"],
    "revit": ["revit", "rvt", "family", "type", "level", "workset", "element", "category", "parameter", "schedule view", "worksharing"],
}


def read_patterns(spark, path: str) -> list[tuple[str, str, float, str | None]]:
    """A full pattern table from a CSV file (domain, words, weight, subdomain), for the ``patterns`` of ``classify_intent``.

    A vocabulary: it becomes part of the query's expressions, so it is read to the driver."""
    rows = spark.read.csv(path, header=True, schema="domain string, words string, weight double, subdomain string")
    return [tuple(r) for r in rows.collect()]
