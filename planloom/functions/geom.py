"""Geometry as Column expressions (lengths, angles, boxes, clipping, WKT)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(s: Column | None = None) -> Column:
    g = _get(s)
    return F.hypot(g("x2") - g("x1"), g("y2") - g("y1"))


def _get(s: Column | None):
    return (lambda c: s[c]) if s is not None else F.col


def angle360(s: Column | None = None) -> Column:
    """Direction of a line in degrees, 0 <= angle < 360."""
    g = _get(s)
    a = F.degrees(F.atan2(g("y2") - g("y1"), g("x2") - g("x1")))
    return F.when(a < 0, a + 360.0).otherwise(a)


def angle180(s: Column | None = None) -> Column:
    """Direction without orientation, 0 <= angle < 180."""
    a = angle360(s)
    return F.when(a >= 180.0, a - 180.0).otherwise(a)


def angle_gap(a: Column, b: Column) -> Column:
    """Smallest difference of two directions that ignore orientation (0..90)."""
    d = F.abs(a - b) % 180.0
    return F.least(d, 180.0 - d)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x1 - x2, y1 - y2
    return F.sqrt(dx * dx + dy * dy)


def mid(s: Column | None = None) -> tuple[Column, Column]:
    g = _get(s)
    return (g("x1") + g("x2")) / 2.0, (g("y1") + g("y2")) / 2.0


def leaning_box(lean: float) -> list[Column]:
    """Box (min_x, min_y, max_x, max_y) of a line, widened by ``lean`` times its length (column ``len``)."""
    more = F.col("len") * lean
    return [F.least("x1", "x2") - more, F.least("y1", "y2") - more, F.greatest("x1", "x2") + more, F.greatest("y1", "y2") + more]


def point_to_line(s: Column, px: Column, py: Column) -> Column:
    """Distance of a point from the infinite line through ``s``; null for a zero-length line."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    n = F.sqrt(dx * dx + dy * dy)
    return F.when(n > 0, F.abs((py - s["y1"]) * dx - (px - s["x1"]) * dy) / n)


def projection(s: Column, t: Column) -> tuple[Column, Column, Column, Column]:
    """Intervals (lo, hi) of ``s`` and of ``t`` along the direction of ``s``."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    n = F.sqrt(dx * dx + dy * dy)
    ux, uy = dx / n, dy / n
    p = lambda r, i: r[f"x{i}"] * ux + r[f"y{i}"] * uy
    return (F.least(p(s, 1), p(s, 2)), F.greatest(p(s, 1), p(s, 2)),
            F.least(p(t, 1), p(t, 2)), F.greatest(p(t, 1), p(t, 2)))


def overlap_share(s: Column, t: Column) -> tuple[Column, Column]:
    """Overlap of the two intervals and the shorter interval, along the direction of ``s``."""
    a0, a1, b0, b1 = projection(s, t)
    return F.least(a1, b1) - F.greatest(a0, b0), F.least(a1 - a0, b1 - b0)


def box_distance(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Gap between two axis-parallel boxes (0 when they touch)."""
    zero = F.lit(0.0)
    dx = F.greatest(zero, F.greatest(bx0 - ax1, ax0 - bx1))
    dy = F.greatest(zero, F.greatest(by0 - ay1, ay0 - by1))
    return F.sqrt(dx * dx + dy * dy)


def iou(a: Column, b: Column, box=("min_x", "min_y", "max_x", "max_y")) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[box[2]], b[box[2]]) - F.greatest(a[box[0]], b[box[0]]))
    h = F.greatest(F.lit(0.0), F.least(a[box[3]], b[box[3]]) - F.greatest(a[box[1]], b[box[1]]))
    area = lambda r: (r[box[2]] - r[box[0]]) * (r[box[3]] - r[box[1]])
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(F.lit(0.0))


def clip_fraction(s: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Share of a segment inside a box: parameter interval cut by the four half planes."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]

    def span(d, p, lo, hi):
        inside = (p >= lo) & (p <= hi)
        t0 = F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least((lo - p) / d, (hi - p) / d))
        t1 = F.when(d == 0, F.when(inside, F.lit(1.0)).otherwise(F.lit(-1.0))).otherwise(F.greatest((lo - p) / d, (hi - p) / d))
        return t0, t1

    ax, bx = span(dx, s["x1"], x0, x1)
    ay, by = span(dy, s["y1"], y0, y1)
    lo = F.greatest(F.lit(0.0), ax, ay)
    hi = F.least(F.lit(1.0), bx, by)
    return F.greatest(F.lit(0.0), hi - lo)


def segments_cross(s: Column, t: Column) -> Column:
    """Whether two closed segments share a point (orientation test)."""
    def orient(p, q, r):
        (px, py), (qx, qy), (rx, ry) = p, q, r
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def on(p, q, r):
        (px, py), (qx, qy), (rx, ry) = p, q, r
        return (F.least(px, qx) <= rx) & (rx <= F.greatest(px, qx)) & (F.least(py, qy) <= ry) & (ry <= F.greatest(py, qy))

    a, b = (s["x1"], s["y1"]), (s["x2"], s["y2"])
    c, d = (t["x1"], t["y1"]), (t["x2"], t["y2"])
    o1, o2, o3, o4 = orient(a, b, c), orient(a, b, d), orient(c, d, a), orient(c, d, b)
    return (((o1 != o2) & (o3 != o4)) | ((o1 == 0) & on(a, b, c)) | ((o2 == 0) & on(a, b, d))
            | ((o3 == 0) & on(c, d, a)) | ((o4 == 0) & on(c, d, b)))


def pixel_to_drawing(px: Column, py: Column, scale: Column, origin_x: Column, origin_y: Column,
                     height: Column) -> tuple[Column, Column]:
    """Pixel space has y down, drawing space y up; ``scale`` is drawing units per pixel."""
    return (px - origin_x) * scale, (height - py - origin_y) * scale


def drawing_to_pixel(x: Column, y: Column, scale: Column, origin_x: Column, origin_y: Column,
                     height: Column) -> tuple[Column, Column]:
    return x / scale + origin_x, height - (y / scale + origin_y)


def box_of_segments(df, margin: float = 0.0):
    return df.withColumns({
        "min_x": F.least("x1", "x2") - margin, "min_y": F.least("y1", "y2") - margin,
        "max_x": F.greatest("x1", "x2") + margin, "max_y": F.greatest("y1", "y2") + margin})


def point(x: Column, y: Column, z: Column | None = None) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), (F.lit(0.0) if z is None else z.cast("double")).alias("z"))


def ring_points(cx: Column, cy: Column, r: Column, n: int = 32) -> Column:
    """Closed polygon of ``n`` sides around a circle."""
    return arc_points(cx, cy, r, F.lit(0.0), F.lit(360.0), n)


def arc_points(cx: Column, cy: Column, r: Column, start: Column, end: Column, n: int = 16) -> Column:
    """Points along an arc from ``start`` to ``end`` degrees (through 0 when the end is smaller)."""
    a0 = F.radians(start)
    span = F.radians(F.when(end < start, end + 360.0).otherwise(end)) - a0
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(cx + r * F.cos(a0 + span * i / n), cy + r * F.sin(a0 + span * i / n)))


def wkt(points: Column, closed: Column | None = None) -> Column:
    """Text form of a point list: POINT Z, LINESTRING Z or, when closed, POLYGON Z; null when empty."""
    body = F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["z"].cast("string"))), ", ")
    n = F.size(points)
    area = (closed if closed is not None else F.lit(False)) & (n >= 3)
    return (F.when(n == 0, F.lit(None)).when(n == 1, F.concat(F.lit("POINT Z("), body, F.lit(")")))
            .when(area, F.concat(F.lit("POLYGON Z(("), body, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING Z("), body, F.lit(")"))))
