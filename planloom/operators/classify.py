"""Rule-based classes for lines, polylines, circles and image components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.functions import text as T
from planloom.operators import relations as R
from planloom.operators.greedy import greedy_cluster
from planloom.operators.spatial import cell, near_pairs
from planloom.ordered import middle_value
from planloom.staging import Stage


def class_by_linetype(lines: DataFrame) -> DataFrame:
    lt = F.col("linetype")
    kind = (F.when(lt.isin("DASHED", "HIDDEN", "HIDDEN2"), "hidden").when(lt.isin("CENTER", "CENTER2", "CENTERLINE"), "centerline")
            .when(lt.isin("PHANTOM", "PHANTOM2"), "property").otherwise("unknown"))
    conf = F.when(kind == "unknown", 0.5).when(kind == "property", 0.7).otherwise(0.9)
    return lines.withColumns({"geometry_type": kind, "cls_confidence": conf})


def class_walls(pairs: DataFrame, low: float = 3.0, high: float = 12.0) -> DataFrame:
    return pairs.where(F.col("spacing").between(low, high) & (F.col("is_orthogonal") | (F.col("length") > 100)))


def class_ducts(pairs: DataFrame, low: float = 4.0, high: float = 48.0) -> DataFrame:
    return pairs.where(F.col("spacing").between(low, high) & F.col("is_orthogonal"))


def pair_label(pairs: DataFrame, digits: int) -> DataFrame:
    """(id, size): each line of the pairs with the spacing of its last pair (by ids) as size text."""
    rows = pairs.select(F.explode(F.array("id1", "id2")).alias("id"), "id1", "id2", "spacing")
    last = rows.groupBy("id").agg(F.max_by("spacing", F.struct("id1", "id2")).alias("s"))
    return last.select("id", F.format_string(f'%.{digits}f"', "s").alias("size"))


def _places(df: DataFrame) -> DataFrame:
    """Distinct positions: enough for every 'is one near' test, however many rows share a place."""
    return df.select("project_id", "x", "y").distinct()


def ends_near(lines: DataFrame, points: DataFrame, distance: float) -> DataFrame:
    """(id, ends): number of a line's ends (1 or 2) closer than ``distance`` to a point."""
    ends = R.endpoints(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    p = near_pairs(ends, _places(points), distance, on=["project_id"], strict=True)
    return p.select(F.col("a.id").alias("id"), F.col("a.end_no").alias("end_no")).distinct().groupBy("id").agg(F.count(F.lit(1)).alias("ends"))


def mids_near(lines: DataFrame, texts: DataFrame, distance: float) -> DataFrame:
    """(id, text): first text (by id) closer than ``distance`` to the line's midpoint."""
    mx, my = geom.mid()
    m = lines.select("id", "project_id", mx.alias("x"), my.alias("y"))
    one = texts.groupBy("project_id", "x", "y").agg(F.min_by("text", "id").alias("text"), F.min("id").alias("id"))
    p = near_pairs(m, one, distance, on=["project_id"], strict=True)
    return p.groupBy(F.col("a.id").alias("id")).agg(F.min_by("b.text", "b.id").alias("text"))


def class_pipes(lines: DataFrame, symbols: DataFrame, texts: DataFrame, tolerance: float = 10.0) -> DataFrame:
    """Lines with an end near a plumbing symbol; both ends raise the confidence; size from a text near the middle."""
    sym = symbols.where((F.col("category") == "plumbing") & F.col("kind").isin("valve", "fitting", "fixture"))
    near = ends_near(lines, sym, tolerance)
    size = mids_near(lines.join(near, "id", "left_semi"), texts.where(F.trim("text").rlike(T.PIPE_SIZE_TEXT)), 50.0)
    return near.join(size, "id", "left").select("id", F.when(F.col("ends") == 2, 0.75).otherwise(0.60).alias("cls_confidence"), F.col("text").alias("size"))


def class_conduits(lines: DataFrame, symbols: DataFrame, tolerance: float = 10.0) -> DataFrame:
    near = ends_near(lines, symbols.where("category = 'electrical'"), tolerance)
    return near.select("id", F.when(F.col("ends") == 2, 0.70).otherwise(0.55).alias("cls_confidence"))


def class_dimensions(lines: DataFrame, texts: DataFrame) -> DataFrame:
    return mids_near(lines, texts.where(F.trim("text").rlike(T.DIMENSION_TEXT)), 30.0).select("id")


def class_leaders(lines: DataFrame, symbols: DataFrame, texts: DataFrame) -> DataFrame:
    return ends_near(lines, texts, 20.0).select("id").join(ends_near(lines, symbols, 30.0), "id", "left_semi")


def classify_lines(lines: DataFrame, symbols: DataFrame, texts: DataFrame, drawing_type: str = "unknown") -> DataFrame:
    """(id, geometry_type, system, cls_confidence, size) for every line.

    Line type first; then walls and ducts from parallel pairs (ducts win); then, for lines still unknown, pipes,
    conduits, dimensions and leaders in that order, depending on the drawing type.
    """
    stage = Stage(lines.sparkSession, "classify")
    base = stage.write(class_by_linetype(lines.select("id", "project_id", "x1", "y1", "x2", "y2", "linetype")))
    pairs = stage.write(R.parallel_pairs(base.where("geometry_type not in ('hidden', 'centerline')")))
    none = F.lit(None).cast("string")
    cur = base.select("id", "geometry_type", none.alias("system"), "cls_confidence", none.alias("size"))

    def put(cur, found, kind, system, conf, size, only_unknown):
        f = found.select("id", F.lit(True).alias("_h"), (F.col("cls_confidence") if conf is None else F.lit(conf)).alias("_c"),
                         (F.col("size") if size else none).alias("_z"))
        j = cur.join(f, "id", "left")
        hit = F.coalesce("_h", F.lit(False)) & ((F.col("geometry_type") == "unknown") if only_unknown else F.lit(True))
        return j.select("id", F.when(hit, kind).otherwise(F.col("geometry_type")).alias("geometry_type"),
                        F.when(hit, F.lit(system)).otherwise(F.col("system")).alias("system"),
                        F.when(hit, F.col("_c")).otherwise(F.col("cls_confidence")).alias("cls_confidence"),
                        F.when(hit, F.col("_z")).otherwise(F.col("size")).alias("size"))

    if drawing_type in ("floor_plan", "unknown"):
        cur = put(cur, pair_label(class_walls(pairs), 1), "wall", None, 0.85, True, False)
    if drawing_type in ("hvac_plan", "mep_plan", "unknown"):
        cur = put(cur, pair_label(class_ducts(pairs), 0), "duct_rectangular", "supply_air", 0.80, True, False)
    cur = stage.write(cur)
    # the tests below look at single lines, so they run once over the lines that are still unknown
    rest = stage.write(base.join(cur.where("geometry_type = 'unknown'"), "id", "left_semi"))
    if drawing_type in ("plumbing_plan", "mep_plan", "unknown"):
        cur = put(cur, class_pipes(rest, symbols, texts), "pipe", None, None, True, True)
    if drawing_type in ("electrical_plan", "fire_alarm", "mep_plan"):
        cur = put(cur, class_conduits(rest, symbols), "conduit", "power", None, False, True)
    cur = put(cur, class_dimensions(rest, texts), "dimension", None, 0.85, False, True)
    return put(cur, class_leaders(rest, symbols, texts), "leader", None, 0.80, False, True)


def class_polylines(polylines: DataFrame, doors: DataFrame, drawing_type: str) -> DataFrame:
    """Door swings (an arc that starts or ends near a door) and room boundaries (closed, four or more points).

    ``polylines``: (id, project_id, n_points, closed, has_bulge, x1, y1, x2, y2 = first and last point).
    """
    arcs = polylines.where((F.col("n_points") >= 3) & F.col("has_bulge"))
    swing = ends_near(arcs, doors, 50.0).select("id", F.lit(True).alias("_d"))
    plan = drawing_type in ("floor_plan", "mep_plan")
    room = F.col("closed") & (F.col("n_points") >= 4) & F.lit(plan)
    p = polylines.join(swing, "id", "left")
    return p.select("id", F.when(F.col("_d"), "door_swing").when(room, "room_boundary").otherwise("unknown").alias("geometry_type"),
                    F.when(F.col("_d"), 0.85).when(room, 0.70).otherwise(0.0).alias("cls_confidence"))


def class_circles(circles: DataFrame, drawing_type: str) -> DataFrame:
    """Radius below 10: marker; 10 to 24 on air or services plans: round duct."""
    r = F.col("radius")
    duct = r.between(10, 24) & F.lit(drawing_type in ("hvac_plan", "mep_plan"))
    return circles.select("id", F.when(r < 10, "unknown").when(duct, "duct_round").otherwise("unknown").alias("geometry_type"),
                          F.when(r < 10, 0.3).when(duct, 0.65).otherwise(0.0).alias("cls_confidence"),
                          F.when(duct, F.format_string('%.0f"', r * 2)).alias("size"))


def text_or_graphics(components: DataFrame, area_factor: float = 0.5, max_elongation: float = 10.0, min_height: float = 5.0,
                     max_height: float = 100.0, blocks: int | None = None) -> DataFrame:
    """Component class per page from area against the page's median, elongation and height.

    ``components``: (id, page, area, elongation, height).
    """
    med = middle_value(components, ["page"], "area", "id", "median", blocks)
    c = components.join(med, "page")
    small = F.col("area") < F.col("median") * area_factor
    text = small & (F.col("elongation") < max_elongation) & F.col("height").between(min_height, max_height)
    kind = (F.when(text, "text").when(~small & (F.col("elongation") > max_elongation * 2), "graphics")
            .when(~small & (F.col("height") > max_height), "graphics").when(~small, "mixed").otherwise("graphics"))
    conf = (F.when(text, 0.9).when(~small & (F.col("elongation") > max_elongation * 2), 0.9)
            .when(~small & (F.col("height") > max_height), 0.8).when(~small, F.lit(None).cast("double")).otherwise(0.6))
    return c.select("page", "id", kind.alias("component_type"), conf.alias("confidence"))


def text_lines(components: DataFrame, gap_factor: float = 2.5) -> DataFrame:
    """(page, id, line): characters grouped around the topmost free one by baseline and horizontal gap.

    ``components``: (id, page, x, y, width, height). The gap limit is a multiple of the page's mean width.
    """
    avg = components.groupBy("page").agg(F.avg("width").alias("_w"))
    c = components.join(avg, "page").withColumn("base", F.col("y") + F.col("height"))

    def joins(k, u):
        gap = F.greatest(F.lit(0.0), F.greatest(u["x"] - k["x"] - k["width"], k["x"] - u["x"] - u["width"]))
        return (k["page"] == u["page"]) & (F.abs(u["base"] - k["base"]) < k["height"] * 0.5) & (gap < k["_w"] * gap_factor)

    # a line starter reaches half its height up and down; cells are as tall as the reach of its height class
    tall = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("height"), F.lit(1.0)))))
    levels = sorted({int(r[0]) for r in components.select(F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest("height", F.lit(1.0)))))).distinct().collect()})
    sizes = F.array(*[F.lit(float(v)) for v in levels])
    home = F.transform(sizes, lambda s: F.xxhash64("page", s, F.floor(F.col("base") / s)))
    row = F.floor(F.col("base") / tall)
    reach = F.transform(F.sequence((row - 1).cast("long"), (row + 1).cast("long")), lambda i: F.xxhash64("page", tall, i))
    like = [F.col("page"), cell(F.col("base"), 1.0), F.floor(F.col("x") / F.greatest(F.col("_w"), F.lit(1.0)))]
    g = greedy_cluster(c, [F.col("y")], home, reach, joins, like)
    return g.select(F.col("u.page").alias("page"), F.col("u.id").alias("id"), F.col("seed.id").alias("line"))
