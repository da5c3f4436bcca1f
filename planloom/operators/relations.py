"""Edges between elements: proximity, overlap, layers, containment, line ends and adjacency."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.operators.spatial import near_pairs, nearest, overlap_pairs, overlap_self
from planloom.skew import salted_join, shuffled, widen
from planloom.staging import materialize

XYZ = ("x", "y", "z")
BOX = ("min_x", "min_y", "max_x", "max_y")


def edge(k: Column, a: Column, b: Column, kind: str, distance: Column | None = None) -> list[Column]:
    d = distance if distance is not None else F.lit(None).cast("double")
    return [k.alias("project_id"), a.alias("from_id"), b.alias("to_id"), F.lit(kind).alias("relation_type"), d.alias("distance")]


# -- element edges (J1, J2, J5, J8, J9) ---------------------------------------------------------------

def intersecting_pairs(elements: DataFrame, touching: DataFrame | None = None) -> DataFrame:
    """Box-intersecting pairs of a project, one direction; with ``touching`` (ids) only pairs that hold one."""
    rows = elements.select("id", "project_id", *BOX)
    if touching is None:
        pairs = overlap_self(rows, BOX, ["project_id"])
    else:
        part = rows.join(touching, "id", "left_semi")
        both = overlap_pairs(part, rows, BOX, on=["project_id"], where=lambda a, b: a["id"] != b["id"])
        pairs = both.select(F.when(F.col("a.id") < F.col("b.id"), F.col("a")).otherwise(F.col("b")).alias("a"),
                            F.when(F.col("a.id") < F.col("b.id"), F.col("b")).otherwise(F.col("a")).alias("b"))
        pairs = pairs.dropDuplicates(["a", "b"])
    return pairs.select(*edge(F.col("a.project_id"), F.col("a.id"), F.col("b.id"), "intersects"))


def segment_intersections(segments: DataFrame) -> DataFrame:
    """Crossing or touching segments of a project (id1 < id2): box cells, then the exact orientation test."""
    rows = geom.box_of_segments(segments.select("id", "project_id", "x1", "y1", "x2", "y2"))
    return overlap_self(rows, BOX, ["project_id"], where=geom.segments_cross, symmetric=True)


def within_distance(elements: DataFrame, radius: float, pos=XYZ, touching: DataFrame | None = None) -> DataFrame:
    """Both directions of every pair of a project within ``radius``, with the distance."""
    rows = elements.select("id", "project_id", *pos)
    other = lambda a, b: a["id"] != b["id"]
    if touching is None:
        pairs = near_pairs(rows, rows, radius, pos, on=["project_id"], where=other)
    else:
        part = rows.join(touching, "id", "left_semi")
        out = near_pairs(part, rows, radius, pos, on=["project_id"], where=other)
        pairs = out.unionByName(out.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).distinct()
    return pairs.select(*edge(F.col("a.project_id"), F.col("a.id"), F.col("b.id"), "near", F.col("distance")))


def on_layer_pairs(elements: DataFrame, limit: int = 100, layers: DataFrame | None = None) -> DataFrame:
    """Pairs on the same layer, for layers of at most ``limit`` rows, so a layer gives a bounded number of pairs. ``layers``
    (project_id, layer) narrows the work to some layers."""
    rows = elements.where(F.col("layer").isNotNull()).select("id", "project_id", "layer")
    if layers is not None:
        rows = rows.join(layers, ["project_id", "layer"], "left_semi")
    sizes = rows.groupBy("project_id", "layer").count()
    # rows of large layers leave here, before any pair is made; the join is salted because a layer may be hot
    small = salted_join(rows, sizes.where(F.col("count") <= limit).drop("count"), ["project_id", "layer"], how="left_semi")
    other = small.select("project_id", "layer", F.col("id").alias("id2"))
    pairs = small.join(other, ["project_id", "layer"]).where(F.col("id") < F.col("id2"))
    return pairs.select(*edge(F.col("project_id"), F.col("id"), F.col("id2"), "on_layer"))


def all_edges(elements: DataFrame, radius: float, layer_limit: int = 100) -> DataFrame:
    return (intersecting_pairs(elements).unionByName(within_distance(elements, radius))
            .unionByName(on_layer_pairs(elements, layer_limit)))


def recompute_edges(edges: DataFrame, elements: DataFrame, changed: DataFrame, radius: float,
                    layer_limit: int = 100, before: DataFrame | None = None) -> DataFrame:
    """Edges after ``changed`` ids changed; equal to a full recompute.

    Edges at a changed element are dropped and rebuilt. ``on_layer`` edges can also appear or vanish between unchanged
    elements when a layer crosses its size limit. With ``before``, the changed elements' rows as they were (id, project_id,
    layer), only the layers that hold or held a changed element are rebuilt; without it all layers are, since a layer that an
    element has left may have had too many rows to leave edges.
    """
    ids = changed.select("id").distinct()
    far = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti") \
               .join(ids.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*edges.columns)
    near = far.where(F.col("relation_type") != "on_layer")
    fresh = intersecting_pairs(elements, ids).unionByName(within_distance(elements, radius, touching=ids))
    if before is None:
        return near.unionByName(fresh).unionByName(on_layer_pairs(elements, layer_limit))
    now = elements.join(ids, "id", "left_semi").select("project_id", "layer")
    layers = now.union(before.join(ids, "id", "left_semi").select("project_id", "layer")).where(F.col("layer").isNotNull()).distinct()
    at = elements.join(layers, ["project_id", "layer"], "left_semi").select(F.col("id").alias("from_id"))
    same = far.where(F.col("relation_type") == "on_layer").join(at, "from_id", "left_anti").select(*edges.columns)
    return near.unionByName(same).unionByName(fresh).unionByName(on_layer_pairs(elements, layer_limit, layers))


def edge_changes(edges: DataFrame, elements: DataFrame, changed: DataFrame, before: DataFrame, radius: float, layer_limit: int = 100) -> DataFrame:
    """What a change of elements does to their edges: the edges to add (or set to a new distance) and to remove (``op``).

    ``elements`` and ``before`` are all elements after and before the change, ``changed`` the ids. Only edges at a changed
    element and ``on_layer`` edges of the layers that hold or held one are looked at. Nothing is said about edges that stay.
    """
    ids = changed.select("id").distinct()
    layers = (elements.join(ids, "id", "left_semi").select("project_id", "layer")
              .union(before.join(ids, "id", "left_semi").select("project_id", "layer")).where(F.col("layer").isNotNull()).distinct())
    members = elements.join(layers, ["project_id", "layer"], "left_semi").select(F.col("id").alias("from_id"))
    ends = [edges.join(ids.withColumnRenamed("id", c), c, "left_semi").select(*edges.columns) for c in ("from_id", "to_id")]
    on_layer = edges.where(F.col("relation_type") == "on_layer").join(members, "from_id", "left_semi").select(*edges.columns)
    stale = ends[0].unionByName(ends[1]).unionByName(on_layer).distinct()
    fresh = (intersecting_pairs(elements, ids).unionByName(within_distance(elements, radius, touching=ids))
             .unionByName(on_layer_pairs(elements, layer_limit, layers)).select(*edges.columns).distinct())
    side = lambda n: F.max(F.when(F.col("_s") == n, F.struct("distance")))
    both = stale.withColumn("_s", F.lit(1)).unionByName(fresh.withColumn("_s", F.lit(2)))
    both = both.groupBy("project_id", "from_id", "to_id", "relation_type").agg(side(1).alias("was"), side(2).alias("now")).where(~F.col("was").eqNullSafe(F.col("now")))
    change = both.withColumn("distance", F.coalesce("now", "was")["distance"]).withColumn("op", F.when(F.col("now").isNull(), "remove").otherwise("add"))
    return change.select(*edges.columns, "op")


# -- one reference element or point (J3, J4, J6, J7, J24) ----------------------------------------------

def nearby(elements: DataFrame, ref: DataFrame, radius: float, pos=XYZ) -> DataFrame:
    """Elements of the reference's project within ``radius`` of it (``ref`` holds one row)."""
    one = ref.select(F.col("id").alias("ref_id"), F.col("project_id"), *[F.col(p).alias(f"r{p}") for p in pos]).limit(1)
    joined = elements.join(F.broadcast(one), "project_id").where(F.col("id") != F.col("ref_id"))
    d2 = sum(((F.col(p) - F.col(f"r{p}")) * (F.col(p) - F.col(f"r{p}")) for p in pos), F.lit(0.0))
    return joined.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius).drop(*[f"r{p}" for p in pos], "ref_id")


def near_point(elements: DataFrame, point: tuple[float, ...], radius: float, entity_type: str | None = None) -> DataFrame:
    pos = XYZ[: len(point)]
    df = elements.where(F.col("entity_type") == entity_type) if entity_type else elements
    for p, v in zip(pos, point):
        df = df.where(F.col(p).between(v - radius, v + radius))
    d2 = sum(((F.col(p) - v) * (F.col(p) - v) for p, v in zip(pos, point)), F.lit(0.0))
    return df.withColumn("distance", F.sqrt(d2)).where(F.col("distance") <= radius)


def intersecting_with(elements: DataFrame, ref: DataFrame) -> DataFrame:
    one = ref.select("project_id", F.col("id").alias("ref_id"), *[F.col(c).alias(f"r_{c}") for c in BOX]).limit(1)
    hit = ((F.col("min_x") <= F.col("r_max_x")) & (F.col("max_x") >= F.col("r_min_x"))
           & (F.col("min_y") <= F.col("r_max_y")) & (F.col("max_y") >= F.col("r_min_y")) & (F.col("id") != F.col("ref_id")))
    return elements.join(F.broadcast(one), "project_id").where(hit).drop("ref_id", *[f"r_{c}" for c in BOX])


def related(edges: DataFrame, ids: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(id, other) neighbours in either direction, distinct, for the given ids."""
    e = edges.where(F.col("relation_type").isin(types)) if types else edges
    both = e.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).unionByName(
        e.select(F.col("to_id").alias("id"), F.col("from_id").alias("other")))
    return both.join(shuffled(ids.select("id").distinct()), "id", "left_semi").distinct()


def clearance_around(elements: DataFrame, ref: DataFrame, minimum: float) -> DataFrame:
    """Neighbours within 1.5 times the clearance; those below it are violations with their shortage."""
    bad = F.col("distance") < minimum
    return nearby(elements, ref, 1.5 * minimum).withColumns({
        "violation": bad, "shortage": F.when(bad, F.lit(minimum) - F.col("distance"))})


# -- pairs of systems (J22, J23) -------------------------------------------------------------------------

def clashes(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Pairs of two systems closer than ``tolerance`` with the midpoint."""
    cols = ["id", "project_id", *XYZ]
    p = near_pairs(a.select(*cols), b.select(*cols), tolerance, XYZ, on=["project_id"],
                   where=lambda l, r: l["id"] != r["id"], strict=True)
    half = lambda c: ((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2.0).alias(f"mid_{c}")
    return p.select(F.col("a.project_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance",
                    *[half(c) for c in XYZ])


def spacing_violations(elements: DataFrame, minimum: float) -> DataFrame:
    """Unordered 2D pairs of a project closer than ``minimum``."""
    rows = elements.select("id", "project_id", "x", "y")
    p = near_pairs(rows, rows, minimum, on=["project_id"], where=lambda a, b: a["id"] < b["id"], strict=True)
    return p.select(F.col("a.project_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance",
                    (F.lit(minimum) - F.col("distance")).alias("shortage"))


# -- rooms (J11, J12, J15) ------------------------------------------------------------------------------

def polygon_edges(rooms: DataFrame) -> DataFrame:
    """One row per side of each ``boundary`` (array of points), with the side's number."""
    n = F.size("boundary")
    nxt = F.transform(F.col("boundary"), lambda p, i: F.struct(
        p["x"].alias("x1"), p["y"].alias("y1"),
        F.element_at("boundary", ((i + 1) % n + 1).cast("int"))["x"].alias("x2"),
        F.element_at("boundary", ((i + 1) % n + 1).cast("int"))["y"].alias("y2")))
    return rooms.where(n >= 3).select("id", "project_id", F.posexplode(nxt).alias("side", "e")).select(
        "id", "project_id", "side", "e.*")


def room_boxes(rooms: DataFrame) -> DataFrame:
    ext = lambda f, c: f(F.transform("boundary", lambda p: p[c]))
    return rooms.withColumns({"min_x": ext(F.array_min, "x"), "min_y": ext(F.array_min, "y"),
                              "max_x": ext(F.array_max, "x"), "max_y": ext(F.array_max, "y")})


TERMINALS = ["diffuser", "grille", "register", "outlet", "light", "detector"]


def _inside(boundary: Column, px: Column, py: Column) -> Column:
    """Even-odd rule with half-open sides: a side counts when it rises over the point's y and lies to its right."""
    n = F.size(boundary)

    def hit(p, i):
        q = F.element_at(boundary, ((i + 1) % n + 1).cast("int"))
        reach = (py > F.least(p["y"], q["y"])) & (py <= F.greatest(p["y"], q["y"])) & (px <= F.greatest(p["x"], q["x"]))
        cut = (py - p["y"]) * (q["x"] - p["x"]) / (q["y"] - p["y"]) + p["x"]
        return F.when(reach & ((p["x"] == q["x"]) | (px <= cut)), 1).otherwise(0)

    crossings = F.aggregate(F.transform(boundary, hit), F.lit(0), lambda s, v: s + v)
    return crossings % 2 == 1


def contains_polygon(rooms: DataFrame, points: DataFrame) -> DataFrame:
    """Room/point pairs with the point inside the boundary: box cells first, exact rule as join condition."""
    boxes = room_boxes(rooms.where(F.size("boundary") >= 3))
    p = points.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")})
    return overlap_pairs(p, boxes, BOX, on=["project_id"],
                         where=lambda a, b: _inside(b["boundary"], a["x"], a["y"])).select(
        F.col("b").alias("room"), F.col("a").alias("point"))


def containment_edges(rooms: DataFrame, symbols: DataFrame) -> DataFrame:
    """``contains`` edges (0.95) and, for terminal kinds, ``serves`` edges back to the room (0.90)."""
    hits = contains_polygon(rooms, symbols)
    base = hits.select(F.col("room.project_id"), F.col("room.id").alias("room_id"),
                       F.col("point.id").alias("symbol_id"), F.col("point.kind").alias("kind"))
    one = F.struct(F.lit("contains").alias("relation_type"), F.col("room_id").alias("from_id"),
                   F.col("symbol_id").alias("to_id"), F.lit(0.95).alias("confidence"))
    two = F.when(F.col("kind").isin(TERMINALS), F.struct(
        F.lit("serves").alias("relation_type"), F.col("symbol_id").alias("from_id"),
        F.col("room_id").alias("to_id"), F.lit(0.9).alias("confidence")))
    return base.select("project_id", F.explode(F.array_compact(F.array(one, two))).alias("e")).select("project_id", "e.*")


def contains_bbox(rooms: DataFrame, points: DataFrame) -> DataFrame:
    """Closed box containment (the looser of the two containment rules)."""
    p = points.withColumns({"min_x": F.col("x"), "max_x": F.col("x"), "min_y": F.col("y"), "max_y": F.col("y")})
    return overlap_pairs(p, room_boxes(rooms), BOX, on=["project_id"]).select(F.col("b").alias("room"), F.col("a").alias("point"))


def rooms_adjacent(rooms: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Rooms with near-parallel sides (cross <= 0.1) within ``tolerance`` that overlap by more than 10 %.

    Sides meet in fans of directions as in ``parallel_pairs``: in the fan of the first one, sides that qualify are at most the
    tolerance and a tenth of a side apart across, and next to nothing along. Each is widened by its own tenth and half of the
    tolerance; across coordinates are stretched so that a side's box is about as tall as long.
    """
    fans, stretch = 10, 2.5
    width = 180.0 / fans
    slack = math.degrees(math.asin(0.1)) + 1e-6
    slope = math.sin(math.radians(width / 2 + slack))
    fan = lambda direction: F.floor(direction / width + 0.5).cast("int")
    sides = polygon_edges(widen(rooms.select("id", "project_id", "boundary"))).withColumn("len", geom.length()).where(F.col("len") >= 1.0).select(
        "id", "project_id", "x1", "y1", "x2", "y2", "len", geom.angle180().alias("angle"),
        ((F.col("x2") - F.col("x1")) / F.col("len")).alias("ux"), ((F.col("y2") - F.col("y1")) / F.col("len")).alias("uy"))
    within = F.sequence(fan(F.col("angle") - slack), fan(F.col("angle") + slack))
    sides = sides.select("*", F.pmod(fan(F.col("angle")), F.lit(fans)).alias("own_fan"),
                         F.explode(F.array_distinct(F.transform(within, lambda k: F.pmod(k, F.lit(fans))))).alias("fan"))
    cos, sin = F.cos(F.radians(F.col("fan") * width)), F.sin(F.radians(F.col("fan") * width))
    along = [F.col(f"x{i}") * cos + F.col(f"y{i}") * sin for i in (1, 2)]
    across = [F.col(f"y{i}") * cos - F.col(f"x{i}") * sin for i in (1, 2)]
    far = F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")])
    room = tolerance / 2 + F.col("len") * 0.1
    out, wide = room * slope + far * 1e-9 + 1e-6, room + far * 1e-9 + 1e-6
    sides = sides.withColumns({"min_x": F.least(*along) - out, "max_x": F.greatest(*along) + out,
                               "min_y": (F.least(*across) - wide) * stretch, "max_y": (F.greatest(*across) + wide) * stretch}).drop("angle")

    def touching(a, b):
        off = F.abs((b["y1"] - a["y1"]) * a["ux"] - (b["x1"] - a["x1"]) * a["uy"])
        place = lambda s, i: s[f"x{i}"] * a["ux"] + s[f"y{i}"] * a["uy"]
        (a0, a1), (b0, b1) = ((F.least(place(s, 1), place(s, 2)), F.greatest(place(s, 1), place(s, 2))) for s in (a, b))
        return ((a["id"] < b["id"]) & (F.abs(a["ux"] * b["uy"] - a["uy"] * b["ux"]) <= 0.1) & (off <= tolerance)
                & (F.least(a1, b1) - F.greatest(a0, b0) > F.least(a1 - a0, b1 - b0) * 0.1))

    sides = materialize(sides, "sides")
    first = sides.where(F.col("fan") == F.col("own_fan")).drop("own_fan")
    pairs = overlap_pairs(first, sides.drop("own_fan"), BOX, on=["project_id", "fan"], where=touching, step=1)
    return pairs.select(F.col("a.project_id"), F.col("a.id").alias("room1"), F.col("b.id").alias("room2")).distinct()


# -- lines and symbols (J13, J14, J16, J17) ------------------------------------------------------------

def endpoints(lines: DataFrame) -> DataFrame:
    """Two rows per line: ``end_no`` 0 (start) and 1 (end) at (x, y)."""
    ends = F.array(F.struct(F.lit(0).alias("end_no"), F.col("x1").alias("x"), F.col("y1").alias("y")),
                   F.struct(F.lit(1).alias("end_no"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    keep = [c for c in lines.columns if c not in ("x1", "y1", "x2", "y2")]
    return lines.select(*keep, F.explode(ends).alias("e")).select(*keep, "e.*")


def line_symbol_edges(lines: DataFrame, symbols: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Line ends closer than ``tolerance`` to a symbol; confidence falls from 1 to 0.5."""
    ends = endpoints(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    p = near_pairs(ends, symbols.select("id", "project_id", "x", "y"), tolerance, on=["project_id"], strict=True)
    return p.select(F.col("a.project_id"), F.col("a.id").alias("line_id"), F.col("a.end_no").alias("end_no"),
                    F.col("b.id").alias("symbol_id"), "distance",
                    F.greatest(F.lit(0.5), 1.0 - F.col("distance") / tolerance).alias("confidence"))


def symbol_symbol_edges(lines: DataFrame, symbols: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Symbols at opposite ends of one line; the first line (by id) gives the length and the direction."""
    hits = line_symbol_edges(lines, symbols, tolerance).select("project_id", "line_id", "end_no", "symbol_id")
    start = hits.where("end_no = 0").select("project_id", "line_id", F.col("symbol_id").alias("s"))
    end = hits.where("end_no = 1").select("line_id", F.col("symbol_id").alias("t"))
    pairs = start.join(end, "line_id").where(F.col("s") != F.col("t")).withColumns(
        {"symbol1": F.least("s", "t"), "symbol2": F.greatest("s", "t")})
    first = pairs.groupBy("project_id", "symbol1", "symbol2").agg(F.min("line_id").alias("line_id"))
    sizes = lines.select(F.col("id").alias("line_id"), geom.length().alias("length"))
    return first.join(sizes, "line_id").select("project_id", "symbol1", "symbol2", "line_id", "length",
                                               F.lit(0.85).alias("confidence"))


def symbol_near(symbols: DataFrame, radius: float = 50.0) -> DataFrame:
    """Unordered symbol pairs with 0 < distance < radius and a confidence that falls with the distance."""
    rows = symbols.select("id", "project_id", "x", "y")
    p = near_pairs(rows, rows, radius, on=["project_id"], where=lambda a, b: a["id"] < b["id"], strict=True)
    return p.where("distance > 0").select(
        F.col("a.project_id"), F.col("a.id").alias("id1"), F.col("b.id").alias("id2"), "distance",
        F.greatest(F.lit(0.5), 1.0 - F.col("distance") / radius).alias("confidence"))


def nearest_symbol(texts: DataFrame, symbols: DataFrame, radius: float = 50.0) -> DataFrame:
    """Each text's nearest symbol closer than ``radius``."""
    hit = nearest(texts.select("id", "project_id", "x", "y"), symbols.select("id", "project_id", "x", "y"), radius, on=["project_id"])
    return hit.select(F.col("a.project_id"), F.col("a.id").alias("text_id"), F.col("b.id").alias("symbol_id"), "distance",
                      F.greatest(F.lit(0.5), 1.0 - F.col("distance") / radius).alias("confidence"))


def hosted_edges(pairs: DataFrame, elements: DataFrame) -> DataFrame:
    """Host/hosted pairs given by source id, resolved to element ids; unresolved pairs are dropped."""
    key = elements.select("project_id", "source_id", "id")
    return (pairs.join(key.select("project_id", F.col("source_id").alias("host_source"), F.col("id").alias("from_id")),
                       ["project_id", "host_source"])
            .join(key.select("project_id", F.col("source_id").alias("hosted_source"), F.col("id").alias("to_id")),
                  ["project_id", "hosted_source"])
            .select("project_id", "from_id", "to_id", "relation_type"))


# -- parallel lines (J25) ---------------------------------------------------------------------------------

def parallel_pairs(lines: DataFrame, angle_tolerance: float = 3.0, low: float = 1.0, high: float = 72.0,
                   share: float = 0.3, orthogonal_tolerance: float = 5.0) -> DataFrame:
    """Pairs of near-parallel lines at a spacing of ``low``..``high`` that overlap by more than ``share``.

    Near-parallel lines share a fan of directions, in whose frame (along and across its middle) lines that face each other are
    at most ``high`` apart across and next to nothing along, more only by the slope. A line is in the fans within the tolerance of
    its direction; a pair is taken in the fan of its first line. Boxes are widened by half of what a pair may be apart, across
    coordinates shrunk so that a box is about as tall as long, and the three exact tests run inside the join.
    """
    size = geom.length()
    fans = max(2, 2 * int(90.0 / (3.0 * angle_tolerance))) if angle_tolerance > 0 else 60
    width = 180.0 / fans
    slope = math.sin(math.radians(min(90.0, width / 2 + angle_tolerance)))
    shrink = max(slope, 0.125)
    fan = lambda direction: F.floor(direction / width + 0.5).cast("int")
    slack = angle_tolerance + 1e-6
    rows = lines.where(size > 0).select(
        "id", "project_id", "x1", "y1", "x2", "y2", size.alias("len"), geom.angle360().alias("angle"),
        ((F.col("x2") - F.col("x1")) / size).alias("ux"), ((F.col("y2") - F.col("y1")) / size).alias("uy"))
    within = F.sequence(fan(F.col("angle") % 180.0 - slack), fan(F.col("angle") % 180.0 + slack))
    rows = rows.select("*", F.pmod(fan(F.col("angle") % 180.0), F.lit(fans)).alias("own_fan"),
                       F.explode(F.array_distinct(F.transform(within, lambda k: F.pmod(k, F.lit(fans))))).alias("fan"))
    cos, sin = F.cos(F.radians(F.col("fan") * width)), F.sin(F.radians(F.col("fan") * width))
    along = [F.col(f"x{i}") * cos + F.col(f"y{i}") * sin for i in (1, 2)]
    across = [F.col(f"y{i}") * cos - F.col(f"x{i}") * sin for i in (1, 2)]
    far = F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")])
    room = high / 2 + F.col("len") * (math.sin(math.radians(min(90.0, angle_tolerance))) / 2)
    out, side = room * slope + far * 1e-9 + 1e-6, room + far * 1e-9 + 1e-6
    rows = rows.withColumns({"min_x": F.least(*along) - out, "max_x": F.greatest(*along) + out,
                             "min_y": (F.least(*across) - side) * shrink, "max_y": (F.greatest(*across) + side) * shrink})

    def facing(a, b):
        diff = F.abs(a["angle"] - b["angle"])
        gap = F.abs(((b["y1"] + b["y2"]) / 2.0 - a["y1"]) * a["ux"] - ((b["x1"] + b["x2"]) / 2.0 - a["x1"]) * a["uy"])
        # along a, starting at its first end: a covers 0..len, b covers t1..t2
        t1 = (b["x1"] - a["x1"]) * a["ux"] + (b["y1"] - a["y1"]) * a["uy"]
        t2 = (b["x2"] - a["x1"]) * a["ux"] + (b["y2"] - a["y1"]) * a["uy"]
        shared = F.least(a["len"], F.greatest(t1, t2)) - F.greatest(F.lit(0.0), F.least(t1, t2))
        near = (diff <= angle_tolerance) | (F.abs(diff - 180.0) <= angle_tolerance) | (diff >= 360.0 - angle_tolerance)
        return (a["id"] < b["id"]) & near & gap.between(low, high) & (shared > F.least(a["len"], F.abs(t2 - t1)) * share)

    # first lines and later ones apart, so that the tests are written once: for both orders of a pair the code gets too long
    # for the compiler of the JVM
    first = rows.where(F.col("fan") == F.col("own_fan")).drop("own_fan")
    pairs = overlap_pairs(first, rows.drop("own_fan"), BOX, on=["project_id", "fan"], where=facing)
    a, b = F.col("a"), F.col("b")
    turn = a["angle"] % 90.0
    return pairs.select(
        a["project_id"].alias("project_id"), a["id"].alias("id1"), b["id"].alias("id2"),
        geom.point_to_line(a, *geom.mid(b)).alias("spacing"),
        ((geom.length(a) + geom.length(b)) / 2.0).alias("length"),
        ((F.abs(turn) < orthogonal_tolerance) | (F.abs(turn - 90.0) < orthogonal_tolerance)).alias("is_orthogonal"),
        *[((a[c] + b[c]) / 2.0).alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")])
