"""Cleaning and refining drawing geometry."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.operators import dedup
from planloom.operators.graph import components
from planloom.operators.greedy import greedy_cluster
from planloom.operators.relations import BOX, endpoints
from planloom.operators.spatial import box_keys, nearest, overlap_pairs
from planloom.operators.windows import interval_gaps, is_dashed
from planloom.skew import salted_join
from planloom.staging import Stage, materialize

# fixed values: default limits of the cleaning steps (pixels, degrees, shares)
LIMITS = {"min_line": 10.0, "min_arc_span": 15.0, "text_share": 0.3, "arc_completeness": 0.15, "min_confidence": 0.3,
          "margin": 5.0, "min_circle": 3.0}


def arc_span() -> Column:
    s = F.abs(F.col("end_angle") - F.col("start_angle"))
    return F.when(s > 180, 360 - s).otherwise(s)


def too_short(scale: float, min_line: float, min_span: float) -> Column:
    """Lines shorter than ``min_line`` pixels (length / scale) and arcs below ``min_span`` degrees."""
    return ((F.col("kind") == "line") & (geom.length() / scale < min_line)) | ((F.col("kind") == "arc") & (arc_span() < min_span))


def incomplete_arc(share: float) -> Column:
    return (F.col("kind") == "arc") & (arc_span() < share * 360.0)


def low_confidence(limit: float) -> Column:
    return F.col("confidence") < limit


def edge_artifact(margin: float, scale: float, width: str = "width", height: str = "height") -> Column:
    """Lines with both ends near the image border, circles that touch it."""
    near = lambda x, y: ((F.col(x) / scale < margin) | (F.col(x) / scale > F.col(width) - margin)
                         | (F.col(y) / scale < margin) | (F.col(y) / scale > F.col(height) - margin))
    cx, cy, r = F.col("cx") / scale, F.col("cy") / scale, F.col("radius")
    touch = (cx - r < margin) | (cx + r > F.col(width) - margin) | (cy - r < margin) | (cy + r > F.col(height) - margin)
    return ((F.col("kind") == "line") & near("x1", "y1") & near("x2", "y2")) | ((F.col("kind") == "circle") & touch)


def tiny_circle(limit: float, scale: float) -> Column:
    return (F.col("kind") == "circle") & (F.col("radius") / scale <= limit)


def text_boxes(texts: DataFrame, char_width: int = 8, min_width: int = 20, min_height: int = 12, padding: int = 3) -> DataFrame:
    """Estimated boxes of texts (x, y, height, text), as the readers mask them."""
    cw = F.greatest(F.lit(char_width), F.floor(F.col("height") * 0.6))
    w = F.greatest(F.lit(min_width), F.length("text") * cw)
    h = F.greatest(F.lit(min_height), F.floor(F.col("height") * 1.5))
    return texts.select("id", "project_id", (F.col("x") - padding).alias("min_x"), (F.col("y") - F.floor(h / 2) - padding).alias("min_y"),
                        (F.col("x") + w + padding).alias("max_x"), (F.col("y") + F.floor(h / 2) + padding).alias("max_y"))


def lines_through_text(lines: DataFrame, boxes: DataFrame, share: float) -> DataFrame:
    """Ids of lines with more than ``share`` of their length inside one text box."""
    rows = geom.box_of_segments(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    hit = overlap_pairs(rows, boxes.select("project_id", *BOX), BOX, on=["project_id"],
                        where=lambda a, b: geom.clip_fraction(a, b["min_x"], b["min_y"], b["max_x"], b["max_y"]) > share)
    return hit.select(F.col("a.id").alias("id")).distinct()


def clean(entities: DataFrame, boxes: DataFrame, scale: float = 1.0, limits: dict[str, float] = LIMITS) -> DataFrame:
    """All entities with the ``reason`` of the first step that removes them (null = kept).

    ``entities``: (id, project_id, kind, x1..y2, cx, cy, radius, start_angle, end_angle, confidence, width, height).
    """
    lm = limits
    lines = entities.where((F.col("kind") == "line") & ~too_short(scale, lm["min_line"], lm["min_arc_span"]))
    hit = lines_through_text(lines, boxes, lm["text_share"]).withColumn("_text", F.lit(True))
    e = entities.join(hit, "id", "left")
    reason = (F.when(too_short(scale, lm["min_line"], lm["min_arc_span"]), "short_segment").when(F.col("_text"), "through_text")
              .when(incomplete_arc(lm["arc_completeness"]), "incomplete_curve").when(low_confidence(lm["min_confidence"]), "low_confidence")
              .when(edge_artifact(lm["margin"], scale), "edge_artifact").when(tiny_circle(lm["min_circle"], scale), "tiny_circle"))
    return e.withColumn("reason", reason).drop("_text")


def clean_stats(cleaned: DataFrame) -> DataFrame:
    return cleaned.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# -- snapping (L8-L12) -------------------------------------------------------------------------------------

def _turn(lines: DataFrame, target: Column, when: Column) -> DataFrame:
    """Second end turned to direction ``target`` (degrees) around the first; the length stays."""
    n = geom.length()
    rad = F.radians(target)
    return lines.withColumns({"x2": F.when(when, F.col("x1") + n * F.cos(rad)).otherwise(F.col("x2")),
                              "y2": F.when(when, F.col("y1") + n * F.sin(rad)).otherwise(F.col("y2"))})


def snap_orthogonal(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines within ``tolerance`` degrees of 0/90/180/270 become exact."""
    a, n = geom.angle360(), geom.length()
    q = F.rint(a / 90.0)
    hit = (n >= 1e-6) & (F.abs(a - q * 90.0) <= tolerance)
    k = q % 4
    dx = F.when(k == 0, n).when(k == 2, -n).otherwise(F.lit(0.0))
    dy = F.when(k == 1, n).when(k == 3, -n).otherwise(F.lit(0.0))
    return lines.withColumns({"x2": F.when(hit, F.col("x1") + dx).otherwise(F.col("x2")),
                              "y2": F.when(hit, F.col("y1") + dy).otherwise(F.col("y2"))})


def align_cardinal(lines: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Lines near 0/45/90/135 degrees (direction ignored) are turned to that direction."""
    a = geom.angle180()
    c = F.rint(a / 45.0) * 45.0
    off = F.abs(a - c)
    moved = (geom.length() >= 0.001) & (off <= tolerance) & (off > 0.01)
    return _turn(lines, c, moved)


def snap_grid(df: DataFrame, cols: list[str], grid: float = 1.0, tolerance: float = 0.1) -> DataFrame:
    line = lambda c: F.rint(F.col(c) / grid) * grid
    return df.withColumns({c: F.when(F.abs(F.col(c) - line(c)) <= tolerance, line(c)).otherwise(F.col(c)) for c in cols})


def _move_ends(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves``: (id, end_no, nx, ny), at most one per end."""
    pick = lambda end, c: F.max(F.when(F.col("end_no") == end, F.col(c)))
    new = moves.groupBy("id").agg(pick(0, "nx").alias("_x1"), pick(0, "ny").alias("_y1"), pick(1, "nx").alias("_x2"), pick(1, "ny").alias("_y2"))
    j = lines.join(new, "id", "left")
    return j.withColumns({c: F.coalesce(f"_{c}", c) for c in ("x1", "y1", "x2", "y2")}).select(*lines.columns)


def connect_endpoints(lines: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """Each end moves to the midpoint with the nearest end of another line within ``tolerance``.

    Ends at one place are one candidate (with two of its line ids, enough to leave out the line itself), so a
    place where very many lines meet costs one comparison per neighbour.
    """
    ends = endpoints(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    ends = ends.withColumn("eid", F.col("id") * 2 + F.col("end_no"))
    places = ends.groupBy("project_id", "x", "y").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    places = places.withColumn("pid", F.struct("x", "y"))
    hit = nearest(ends, places, tolerance, on=["project_id"], lid="eid", rid="pid", strict=False,
                  where=lambda a, b: ((a["x"] != b["x"]) | (a["y"] != b["y"])) & ((b["lo"] != a["id"]) | (b["hi"] != a["id"])))
    mid = lambda c: ((F.col(f"a.{c}") + F.col(f"b.{c}")) / 2.0).alias(f"n{c}")
    return _move_ends(lines, hit.select(F.col("a.id").alias("id"), F.col("a.end_no").alias("end_no"), mid("x"), mid("y")))


def snap_to_junctions(lines: DataFrame, junctions: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Ends closer than ``tolerance`` to a junction move onto the nearest one."""
    ends = endpoints(lines.select("id", "project_id", "x1", "y1", "x2", "y2")).withColumn("eid", F.col("id") * 2 + F.col("end_no"))
    hit = nearest(ends, junctions.select("id", "project_id", "x", "y"), tolerance, on=["project_id"], lid="eid")
    return _move_ends(lines, hit.select(F.col("a.id").alias("id"), F.col("a.end_no").alias("end_no"), F.col("b.x").alias("nx"), F.col("b.y").alias("ny")))


# -- collinear merging (L13) --------------------------------------------------------------------------------

def merge_collinear(lines: DataFrame, distance: float = 5.0, gap: float = 20.0, min_gap: float = 2.0) -> DataFrame:
    """Fragments of one line become one line, DASHED when their gaps are regular.

    Lines of one whole-degree direction cluster around the first (by id) whose track is within ``distance`` and
    whose interval is within ``gap``; the cluster spans the extremes along the first line's direction.
    """
    size = geom.length()
    rows = lines.select("id", "project_id", "x1", "y1", "x2", "y2").withColumns({
        "len": size, "bucket": F.rint(F.pmod(F.degrees(F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1"))), F.lit(180.0))).cast("int")})
    rows = rows.where("len >= 1e-6").withColumns({
        "ux": (F.col("x2") - F.col("x1")) / F.col("len"), "uy": (F.col("y2") - F.col("y1")) / F.col("len")})
    # Lines of a whole degree meet in its frame, at most half a degree off: along they are at most ``gap`` apart, across
    # ``distance`` and what both lean over the gap and the later line. Across is stretched so that one margin does for both.
    far = F.greatest(*[F.abs(c) for c in ("x1", "y1", "x2", "y2")]) * 1e-9 + 1e-6
    aside = distance + 0.018 * max(0.0, gap)
    margin = max(0.0, gap) + 0.018 * aside
    stretch = min(8.0, max(1.0, margin / aside)) if aside > 0 else 8.0
    cos, sin = F.cos(F.radians("bucket")), F.sin(F.radians("bucket"))
    on_x = [F.col(f"x{i}") * cos + F.col(f"y{i}") * sin for i in (1, 2)]
    on_y = [F.col(f"y{i}") * cos - F.col(f"x{i}") * sin for i in (1, 2)]
    lean = F.col("len") * 0.018
    rows = rows.withColumns({"min_x": F.least(*on_x) - far - lean * 0.018, "min_y": (F.least(*on_y) - far - lean) * stretch,
                             "max_x": F.greatest(*on_x) + far + lean * 0.018, "max_y": (F.greatest(*on_y) + far + lean) * stretch})
    home, reach = box_keys(rows, BOX, ["project_id", "bucket"], margin=max(margin, aside * stretch))
    like = [F.col("project_id"), F.col("bucket"), F.floor(F.col("x1") / (distance / 1.5)), F.floor(F.col("y1") / (distance / 1.5))]

    def along(k, u, i):
        return (u[f"x{i}"] - k["x1"]) * k["ux"] + (u[f"y{i}"] - k["y1"]) * k["uy"]

    def same(k, u):
        off = F.abs((u["x1"] - k["x1"]) * -k["uy"] + (u["y1"] - k["y1"]) * k["ux"])
        lo, hi = F.least(along(k, u, 1), along(k, u, 2)), F.greatest(along(k, u, 1), along(k, u, 2))
        return (k["bucket"] == u["bucket"]) & (off <= distance) & (F.greatest(lo - k["len"], -hi) <= gap)

    g = greedy_cluster(rows, [], home, reach, same, like, seed=["id", "project_id", "x1", "y1", "ux", "uy"])
    k, u = F.col("seed"), F.col("u")
    t = g.select(k["id"].alias("id"), k["project_id"].alias("project_id"), u["id"].alias("member"),
                 F.least(along(k, u, 1), along(k, u, 2)).alias("lo"), F.greatest(along(k, u, 1), along(k, u, 2)).alias("hi"),
                 F.struct(k["x1"].alias("x"), k["y1"].alias("y"), k["ux"].alias("ux"), k["uy"].alias("uy")).alias("o"))
    t = materialize(t, "collinear")
    span = t.groupBy("id", "project_id").agg(F.first("o").alias("o"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("members"))
    dashed = is_dashed(interval_gaps(t, ["id"], "lo", "hi", "member"), ["id"], min_gap).select("id", "dashed")
    at = lambda v, c: F.col(f"o.{c}") + F.col(v) * F.col(f"o.u{c}")
    return span.join(dashed, "id", "left").select(
        "id", "project_id", at("lo", "x").alias("x1"), at("lo", "y").alias("y1"), at("hi", "x").alias("x2"), at("hi", "y").alias("y2"),
        "members", F.when(F.coalesce("dashed", F.lit(False)), "DASHED").otherwise("CONTINUOUS").alias("linetype"))


def refine(lines: DataFrame, junctions: DataFrame | None = None, junction_distance: float = 5.0, align: float = 2.0, connect: float = 0.5,
           distance: float = 5.0, gap: float = 20.0, grid: float = 1.0, duplicate: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Snap to junctions, straighten, connect, merge, snap to grid, drop duplicates; with the row count per step."""
    stage = Stage(lines.sparkSession, "refine")
    cur = stage.write(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    counts = [("input", cur)]
    if junctions is not None:
        cur = stage.write(snap_to_junctions(cur, junctions, junction_distance))
        counts.append(("junctions", cur))
    for name, step in (("align", lambda d: align_cardinal(d, align)), ("connect", lambda d: connect_endpoints(d, connect)),
                       ("merge", lambda d: merge_collinear(d, distance, gap).select("id", "project_id", "x1", "y1", "x2", "y2")),
                       ("grid", lambda d: snap_grid(d, ["x1", "y1", "x2", "y2"], grid)),
                       ("duplicates", lambda d: dedup.dedup_lines_endpoints(d, duplicate))):
        cur = stage.write(step(cur))
        counts.append((name, cur))
    stats = None
    for name, df in counts:
        row = df.agg(F.lit(name).alias("step"), F.count(F.lit(1)).alias("n"))
        stats = row if stats is None else stats.unionByName(row)
    return cur, stats


# -- polylines (L15, L16) ------------------------------------------------------------------------------------

def chain_links(lines: DataFrame, grid: float) -> tuple[DataFrame, DataFrame]:
    """Ends snapped to nodes, and the pairs of line ends that meet at a node of degree two."""
    ends = endpoints(lines.select("id", "project_id", "x1", "y1", "x2", "y2"))
    ends = ends.withColumns({"nx": F.rint(F.col("x") / grid) * grid, "ny": F.rint(F.col("y") / grid) * grid})
    node = ends.groupBy("project_id", "nx", "ny").agg(
        F.count(F.lit(1)).alias("deg"), F.min(F.struct("id", "end_no")).alias("p"), F.max(F.struct("id", "end_no")).alias("q"))
    two = node.where("deg = 2 and p.id <> q.id").select(
        F.col("p.id").alias("a"), F.col("p.end_no").alias("a_end"), F.col("q.id").alias("b"), F.col("q.end_no").alias("b_end"))
    return ends, two


def build_polylines(lines: DataFrame, grid: float = 0.1) -> DataFrame:
    """Lines ordered into polylines through nodes of degree two: (polyline_id, seq, id, reversed, closed).

    A line walked towards its end 0 or 1 is one state; a state points to the state of the next line. The rank in the
    chain is the distance to the last state, found by pointer doubling, so a chain of n lines takes log2(n) rounds.
    Of the two directions of a chain the one that starts with the smaller line id is kept.
    """
    stage = Stage(lines.sparkSession, "polylines")
    ends, two = chain_links(lines, grid)
    two = stage.write(two)
    label = stage.write(components(lines.select(F.col("id").alias("node")), two).withColumnRenamed("node", "id"))
    # state = id * 2 + end that is walked to; from there the next line is entered at its linked end
    st = lambda i, e: i * 2 + e
    succ = two.select(st(F.col("a"), F.col("a_end")).alias("s"), st(F.col("b"), 1 - F.col("b_end")).alias("t")).unionByName(
        two.select(st(F.col("b"), F.col("b_end")).alias("s"), st(F.col("a"), 1 - F.col("a_end")).alias("t")))
    states = lines.select("id", F.explode(F.array(F.lit(0), F.lit(1))).alias("e")).select("id", st(F.col("id"), F.col("e")).cast("long").alias("s"))
    states = states.join(label, "id").join(succ, "s", "left")
    # a loop has no last state: cut it where it would enter its smallest line again
    open_ = states.groupBy("component").agg(F.max(F.col("t").isNull()).alias("open"))
    states = salted_join(states, open_, ["component"], how="left")
    cut = ~F.col("open") & (F.floor(F.col("t") / 2) == F.col("component"))
    base = stage.write(states.select("s", "id", "component", "open", F.when(cut, F.lit(None)).otherwise(F.col("t")).alias("t")))
    ptr, last = stage.write_path(base.select("s", "component", F.coalesce("t", "s").alias("p"), F.when(F.col("t").isNull(), 0).otherwise(1).cast("long").alias("d")))
    while True:
        nxt = ptr.select(F.col("s").alias("p"), F.col("p").alias("p2"), F.col("d").alias("d2"))
        step = ptr.join(nxt, "p").select("s", "component", F.col("p2").alias("np"), (F.col("d") + F.col("d2")).alias("d"), (F.col("p2") != F.col("p")).alias("moved"))
        new, path = stage.write_path(step.withColumnRenamed("np", "p"))
        moved = new.where("moved").limit(1).count()
        ptr = new.select("s", "component", "p", "d")
        stage.drop(last)
        last = path
        if not moved:
            break
    # one direction per chain: p is the last state; keep the walk whose first line has the smaller id
    first = ptr.groupBy("component", "p").agg(F.max_by("s", "d").alias("start"), F.max("d").alias("length"))
    keep = first.groupBy("component").agg(F.min(F.struct(F.floor(F.col("start") / 2).alias("line"), "start", "p", "length")).alias("k"))
    keep = keep.select("component", F.col("k.p").alias("p"), F.col("k.length").alias("length"))
    walk = salted_join(ptr, keep, ["component", "p"])
    info = base.select("s", "id", "open")
    return walk.join(info, "s").select(
        F.col("component").alias("polyline_id"), (F.col("length") - F.col("d") + 1).alias("seq"), "id",
        (F.col("s") % 2 == 0).alias("reversed"), (~F.col("open")).alias("closed"))


def polyline_points(lines: DataFrame, walk: DataFrame) -> DataFrame:
    """Vertices of the polylines as rows (polyline_id, seq, x, y): the start of every line and the end of the last."""
    w = walk.join(lines.select("id", "x1", "y1", "x2", "y2"), "id")
    end = w.groupBy("polyline_id").agg(F.max("seq").alias("last"))
    w = w.join(end, "polyline_id")
    r = F.col("reversed")
    pt = lambda n, a, b: F.struct((F.col("seq") + n).alias("seq"), F.when(r, F.col(f"x{b}")).otherwise(F.col(f"x{a}")).alias("x"),
                                  F.when(r, F.col(f"y{b}")).otherwise(F.col(f"y{a}")).alias("y"))
    pts = F.when((F.col("seq") == F.col("last")) & ~F.col("closed"), F.array(pt(0, 1, 2), pt(1, 2, 1))).otherwise(F.array(pt(0, 1, 2)))
    return w.select("polyline_id", F.explode(pts).alias("p")).select("polyline_id", "p.*")


def simplify_rdp(points: DataFrame, group: list[str], epsilon: float) -> DataFrame:
    """Ramer-Douglas-Peucker for all polylines (seq, x, y) at once.

    Every interval of every polyline is one group per round: its farthest point is a partial maximum, and it splits
    the interval when it is farther than ``epsilon``. Rounds = depth of the splits.
    """
    stage = Stage(points.sparkSession, "rdp")
    P = lambda: F.struct("seq", "x", "y")
    ends = points.groupBy(*group).agg(F.min_by(P(), "seq").alias("lo"), F.max_by(P(), "seq").alias("hi"))
    edge = ends.select(*group, F.explode(F.array("lo", "hi")).alias("p")).select(*group, "p.*").distinct()
    kept = stage.write(edge)
    cur = salted_join(points.select(*group, "seq", "x", "y"), ends, group).where("seq > lo.seq and seq < hi.seq")
    cur, last = stage.write_path(cur)
    while not cur.isEmpty():
        dx, dy = F.col("hi.x") - F.col("lo.x"), F.col("hi.y") - F.col("lo.y")
        n = F.hypot(dx, dy)
        d = F.when(n > 0, F.abs((F.col("y") - F.col("lo.y")) * dx - (F.col("x") - F.col("lo.x")) * dy) / n).otherwise(
            F.hypot(F.col("x") - F.col("lo.x"), F.col("y") - F.col("lo.y")))
        far = cur.withColumn("d", d).withColumn("from", F.col("lo.seq")).groupBy(*group, "from").agg(
            F.max_by(F.struct("d", "seq", "x", "y"), F.struct("d", -F.col("seq"))).alias("f"))
        split = stage.write(far.where(F.col("f.d") > epsilon).select(*group, "from", F.struct("f.seq", "f.x", "f.y").alias("mid")))
        kept = kept.unionByName(split.select(*group, "mid.*"))
        nxt = salted_join(cur.withColumn("from", F.col("lo.seq")), split, [*group, "from"]).where("seq <> mid.seq")
        left = F.col("seq") < F.col("mid.seq")
        cur, path = stage.write_path(nxt.select(*group, "seq", "x", "y", F.when(left, F.col("lo")).otherwise(F.col("mid")).alias("lo"),
                                                F.when(left, F.col("mid")).otherwise(F.col("hi")).alias("hi")))
        stage.drop(last)
        last = path
    return kept


