"""Readers: entity files, change manifests, label text, nested standards and analysis documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def read_entities(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None,
                  stream: bool = False, files_per_trigger: int = 100, layers: list[str] | None = None) -> DataFrame:
    """Entity rows from Parquet or JSON files, in batch or as a stream; the layer filter reaches the scan."""
    reader = spark.readStream if stream else spark.read
    reader = reader.format(fmt)
    if schema:
        reader = reader.schema(schema)
    if stream:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.load(path)
    return df.where(F.col("layer").isin(layers)) if layers else df


def file_manifest(spark: SparkSession, path: str, content_hash: bool = False) -> DataFrame:
    """(path, hash, modified) of files; the hash is of the content, or of size and time for files too large to read."""
    files = spark.read.format("binaryFile").load(path)
    h = F.md5("content") if content_hash else F.md5(F.concat_ws("|", "length", F.col("modificationTime").cast("string")))
    return files.select("path", h.alias("hash"), F.col("modificationTime").alias("modified"))


def parse_labels(lines: DataFrame, text: str = "value", path: str = "path") -> DataFrame:
    """``class cx cy w h`` text lines to (image, split, class_id, cx, cy, w, h); malformed lines are dropped."""
    p = F.split(F.trim(F.col(text)), r"\s+")
    num = lambda i: F.get(p, i).try_cast("double")
    return lines.select(
        F.regexp_extract(path, r"([^/]+)\.txt$", 1).alias("image"),
        F.regexp_extract(path, r"/(train|val|test)/", 1).alias("split"),
        F.get(p, 0).try_cast("int").alias("class_id"), num(1).alias("cx"), num(2).alias("cy"),
        num(3).alias("w"), num(4).alias("h")).where("class_id is not null and h is not null")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    return parse_labels(lines)


def flatten_standards(docs: DataFrame, json: str = "doc") -> DataFrame:
    """Nested standards (discipline -> section -> name -> fields) to (discipline, section, name, field, value)."""
    schema = "map<string,map<string,map<string,string>>>"
    d = docs.select("discipline", F.explode(F.from_json(json, schema)).alias("section", "entries"))
    d = d.select("discipline", "section", F.explode("entries").alias("name", "fields"))
    return d.select("discipline", "section", "name", F.explode("fields").alias("field", "value"))


def property_of(props: Column, *names: str) -> Column:
    """First property present under any of its name variants."""
    return F.coalesce(*[F.try_element_at(props, F.lit(n)) for n in names])


# fixed values: entity kind per building-model category
CATEGORY_TYPES = {
    "Walls": "WALL", "Doors": "DOOR", "Windows": "WINDOW", "Floors": "FLOOR", "Ceilings": "CEILING", "Roofs": "ROOF",
    "Stairs": "STAIR", "Railings": "RAILING", "Columns": "COLUMN", "Structural Columns": "COLUMN",
    "Structural Framing": "BEAM", "Furniture": "FURNITURE", "Mechanical Equipment": "EQUIPMENT",
    "Electrical Equipment": "EQUIPMENT", "Plumbing Fixtures": "FIXTURE", "Rooms": "ROOM", "Areas": "AREA",
    "Levels": "LEVEL", "Grids": "GRID",
}


def category_to_type(category: Column, table: dict[str, str] | None = None) -> Column:
    t = table or CATEGORY_TYPES
    m = F.create_map(*[F.lit(v) for kv in t.items() for v in kv])
    return F.when(F.coalesce(category, F.lit("")) == "", "Unknown").otherwise(F.coalesce(m[category], F.upper(category)))


RAW = """struct<type:string,points:array<struct<x:double,y:double,z:double>>,center:struct<x:double,y:double,z:double>,
 start:struct<x:double,y:double,z:double>,end:struct<x:double,y:double,z:double>,radius:double>"""


def to_elements(raw: DataFrame) -> DataFrame:
    """Raw JSON entities (project_id, source, body) to element rows with kind, centroid, bounds and properties.

    Both spellings of each field name are accepted; rows without a handle or element id are dropped.
    """
    m = raw.withColumn("m", F.from_json("body", "map<string,string>"))
    get = lambda *n: property_of(F.col("m"), *n)
    m = m.withColumns({
        "source_id": get("handle", "Handle", "element_id", "ElementId"),
        "g": F.from_json(get("geometry", "Geometry", "location", "Location"), RAW),
        "category": get("category", "Category")})
    # a line or curve is its two ends, a circle its centre widened by the radius, a polyline its points
    pts = F.when(F.col("g.points").isNotNull(), F.col("g.points")).when(
        F.col("g.center").isNotNull(), F.array("g.center")).otherwise(
        F.array_compact(F.array("g.start", "g.end")))
    m = m.withColumn("p", pts).withColumn("r", F.coalesce("g.radius", F.lit(0.0))).where(F.col("source_id").isNotNull())
    axis = lambda c: F.transform("p", lambda q: F.coalesce(q[c], F.lit(0.0)))
    mean = lambda c: F.aggregate(axis(c), F.lit(0.0), lambda s, v: s + v) / F.size("p")
    props = F.map_filter(F.map_concat(
        F.coalesce(F.from_json(get("properties", "Properties", "parameters", "Parameters"), "map<string,string>"),
                   F.create_map().cast("map<string,string>")),
        F.map_from_arrays(F.array(F.lit("_color"), F.lit("_linetype")),
                          F.array(get("color", "Color"), get("linetype", "Linetype")))), lambda k, v: v.isNotNull())
    some = F.size("p") > 0
    return m.select(
        "project_id", "source_id", "source",
        F.when(F.col("source") == "revit", category_to_type(F.col("category"))).otherwise(
            F.coalesce(get("entity_type", "EntityType"), F.lit("Unknown"))).alias("entity_type"),
        get("layer", "Layer").alias("layer"), "category",
        *[F.when(some, mean(c)).alias(c) for c in ("x", "y", "z")],
        F.when(some, F.array_min(axis("x")) - F.col("r")).alias("min_x"),
        F.when(some, F.array_min(axis("y")) - F.col("r")).alias("min_y"),
        F.when(some, F.array_max(axis("x")) + F.col("r")).alias("max_x"),
        F.when(some, F.array_max(axis("y")) + F.col("r")).alias("max_y"), props.alias("properties"))


ANALYSIS = """struct<
 lines:array<struct<x1:double,y1:double,x2:double,y2:double,kind:string,linetype:string,layer:string>>,
 circles:array<struct<cx:double,cy:double,radius:double,kind:string>>,
 arcs:array<struct<cx:double,cy:double,radius:double,start_angle:double,end_angle:double,kind:string>>,
 text:array<struct<x:double,y:double,height:double,content:string,kind:string>>,
 symbols:array<struct<x:double,y:double,kind:string,subtype:string,tag:string>>,
 dimensions:array<struct<x1:double,y1:double,x2:double,y2:double,value:string>>>"""


def explode_analysis(docs: DataFrame, layer_of, text_layer_of, symbol_layer_of, json: str = "doc") -> DataFrame:
    """Nested analysis documents to entity rows in drawing units.

    ``docs``: (doc_id, doc, scale, origin_x, origin_y, height). The six arrays become one array of structs, so the
    document is parsed and exploded once. The layer functions map a kind column to a layer column.
    """
    d = docs.withColumn("a", F.from_json(json, ANALYSIS))
    null = F.lit(None)

    def rows(name, kind, fields, layer, linetype=None):
        def make(e):
            vals = fields(e)
            return F.struct(
                F.lit(kind).alias("entity_kind"), layer(e).alias("layer"),
                *[vals.get(c, null).cast("double").alias(c) for c in
                  ("x1", "y1", "x2", "y2", "cx", "cy", "radius", "start_angle", "end_angle", "height_px")],
                vals.get("text", null).cast("string").alias("text"),
                (linetype(e) if linetype else null).cast("string").alias("linetype"))
        return F.coalesce(F.transform(F.col(f"a.{name}"), make), F.array().cast("array<struct<entity_kind:string,layer:string,x1:double,y1:double,x2:double,y2:double,cx:double,cy:double,radius:double,start_angle:double,end_angle:double,height_px:double,text:string,linetype:string>>"))

    lt = lambda e: (F.when(F.upper(e["linetype"]) == "CONTINUOUS", "Continuous")
                    .when(F.upper(e["linetype"]).isin("DASHED", "HIDDEN"), "HIDDEN").otherwise(F.upper(e["linetype"])))
    pick = lambda *cs: (lambda e: {c: e[c] for c in cs})
    all_rows = F.concat(
        rows("lines", "line", pick("x1", "y1", "x2", "y2"),
             lambda e: F.coalesce(F.when(e["layer"] != "", e["layer"]), layer_of(e["kind"])), lt),
        rows("arcs", "arc", pick("cx", "cy", "radius", "start_angle", "end_angle"), lambda e: layer_of(e["kind"])),
        rows("circles", "circle", pick("cx", "cy", "radius"), lambda e: layer_of(e["kind"])),
        rows("text", "mtext", lambda e: {"cx": e["x"], "cy": e["y"], "height_px": e["height"], "text": e["content"]},
             lambda e: text_layer_of(e["kind"])),
        rows("symbols", "block", lambda e: {"cx": e["x"], "cy": e["y"], "text": e["tag"]}, lambda e: symbol_layer_of(e["kind"])),
        rows("dimensions", "dimension", lambda e: {"x1": e["x1"], "y1": e["y1"], "x2": e["x2"], "y2": e["y2"], "text": e["value"]},
             lambda e: F.lit("G-ANNO-DIMS")))
    e = d.select("doc_id", "scale", "origin_x", "origin_y", "height", F.posexplode(all_rows).alias("pos", "e"))
    tx = lambda c: ((F.col(f"e.{c}") - F.col("origin_x")) * F.col("scale")).alias(c)
    ty = lambda c: ((F.col("height") - F.col(f"e.{c}") - F.col("origin_y")) * F.col("scale")).alias(c)
    ln = lambda c, n: (F.col(f"e.{c}") * F.col("scale")).alias(n)
    return e.select("doc_id", "pos", "e.entity_kind", "e.layer", tx("x1"), ty("y1"), tx("x2"), ty("y2"), tx("cx"), ty("cy"),
                    ln("radius", "radius"), "e.start_angle", "e.end_angle", ln("height_px", "text_height"),
                    "e.text", "e.linetype", F.lit("direct").alias("source"))
