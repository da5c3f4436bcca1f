"""Duplicate suppression, fusion and matching of detections, each as one rule for the greedy operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.functions import text as T
from planloom.operators.greedy import greedy_cluster, greedy_match, greedy_suppress
from planloom.operators.relations import BOX
from planloom.operators.spatial import WIDEN, box_keys, cell, euclid, near_pairs, point_keys

XY = ("x", "y")
ROOT2 = math.sqrt(2.0)
ENDS = ("x1", "y1", "x2", "y2")


def _tile(cols: tuple[str, ...], side: float, *more: Column) -> list[Column]:
    return [F.col("project_id"), *[cell(F.col(c), side) for c in cols], *more]


def nms_distance(df: DataFrame, distance: float) -> DataFrame:
    """Detections nearer than ``distance``: the most confident stays (ties: smallest id)."""
    home, reach = point_keys(XY, distance, ["project_id"])
    return greedy_suppress(df, [-F.col("confidence")], home, reach, lambda k, u: euclid(k, u, XY, XY) < distance,
                           _tile(XY, distance / ROOT2))


def nms_iou(df: DataFrame, limit: float = 0.45) -> DataFrame:
    """Boxes that overlap a kept, more confident box by more than ``limit``."""
    home, reach = box_keys(df, BOX, ["project_id"])
    step = math.log(1.1)
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    lw, lh = (F.floor(F.log(F.greatest(v, F.lit(1e-9))) / step) for v in (w, h))
    # boxes of like size whose corners lie within a tenth of it overlap far more than the limit
    like = [F.col("project_id"), lw, lh, F.floor(F.col("min_x") / (F.exp(lw * step) * 0.1)), F.floor(F.col("min_y") / (F.exp(lh * step) * 0.1))]
    return greedy_suppress(df, [-F.col("confidence")], home, reach, lambda k, u: geom.iou(k, u) > limit, like)


def dedup_lines_overlap(lines: DataFrame, angle: float = 5.0, distance: float = 15.0) -> DataFrame:
    """Longest of near-parallel, near and overlapping lines."""
    rows = lines.withColumns({"len": geom.length(), "ang": geom.angle180()})
    # what the test needs of one line is worked out once for each line: a short test is compiled, a long one interpreted
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = rows.withColumn("size", F.sqrt(dx * dx + dy * dy))
    rows = rows.withColumns({"ux": F.when(F.col("size") > 0, dx / F.col("size")), "uy": F.when(F.col("size") > 0, dy / F.col("size"))})
    own = [F.col(f"x{i}") * F.col("ux") + F.col(f"y{i}") * F.col("uy") for i in (1, 2)]
    rows = rows.withColumns({"lo": F.least(*own), "hi": F.greatest(*own)})
    # the later line's midpoint is near the earlier line; its far parts may lean away by its slope
    home, reach = _by_direction(*box_keys(rows, geom.leaning_box(0.05), ["project_id"], margin=distance * ROOT2), F.col("ang"), angle)
    mx, my = geom.mid()
    like = [F.col("project_id"), F.floor(F.col("ang") / angle), F.floor(mx / (distance / 1.5)), F.floor(my / (distance / 1.5))]

    def same(k, u):
        px, py = geom.mid(u)
        gap = F.abs((py - k["y1"]) * (k["x2"] - k["x1"]) - (px - k["x1"]) * (k["y2"] - k["y1"])) / k["size"]
        b0, b1 = (u[f"x{i}"] * k["ux"] + u[f"y{i}"] * k["uy"] for i in (1, 2))
        lo, hi = k["lo"] - distance, k["hi"] + distance
        return ((k["len"] >= 1.0) & (geom.angle_gap(k["ang"], u["ang"]) <= angle) & (gap < distance)
                & ((b0 >= lo) | (b1 >= lo)) & ((b0 <= hi) | (b1 <= hi)))

    return greedy_suppress(rows, [-F.col("len")], home, reach, same, like, reads=["project_id", *ENDS, "len", "ang", "size", "ux", "uy", "lo", "hi"]).select(*lines.columns)


def _by_direction(home: Column, reach: Column, ang: Column, angle: float) -> tuple[Column, Column]:
    """``home`` and ``reach`` for rows whose directions (0 to 180 degrees, 180 being 0 again) differ by ``angle`` at most."""
    n = max(1, int(180 / (4 * angle)))
    sector = lambda a: F.floor(a * (n / 180)).cast("long")
    near = F.array_distinct(F.transform(F.sequence(sector(ang - angle * WIDEN), sector(ang + angle * WIDEN)), lambda i: F.pmod(i, F.lit(n).cast("long"))))
    own = F.pmod(sector(ang), F.lit(n).cast("long"))
    return (F.transform(home, lambda k: F.xxhash64(k, own)),
            F.flatten(F.transform(reach, lambda k: F.transform(near, lambda i: F.xxhash64(k, i)))))


def dedup_circles(circles: DataFrame, center: float = 30.0, radius: float = 20.0) -> DataFrame:
    """First (by id) of circles with near centres and radii."""
    home, reach = point_keys(("cx", "cy", "radius"), max(center, radius), ["project_id"])
    same = lambda k, u: (euclid(k, u, ("cx", "cy"), ("cx", "cy")) < center) & (F.abs(k["radius"] - u["radius"]) < radius)
    return greedy_suppress(circles, [], home, reach, same, _tile(("cx", "cy"), center / ROOT2, cell(F.col("radius"), radius)),
                           reads=["project_id", "cx", "cy", "radius"])


def _end_keys(tolerance: float) -> tuple[Column, Column, list[Column]]:
    """Keys on both ends at once, so lines that share only one busy end do not meet: by midpoint and extent, which are the
    same in either direction. Where both ends are near, the midpoint is as near and the extents differ by two tolerances at most."""
    extent = [F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))]
    slack = tolerance * (1 + 1e-6)
    home, reach = point_keys([*geom.mid(), *extent], slack, ["project_id"], cells=4.0, radii=[slack, slack, 2 * slack, 2 * slack])
    return home, reach, _tile(ENDS, tolerance / ROOT2)


def _same_ends(tolerance: float):
    def same(k, u):
        d = lambda a, b: euclid(k, u, a, b) < tolerance
        s, e = ("x1", "y1"), ("x2", "y2")
        return (d(s, s) & d(e, e)) | (d(s, e) & d(e, s))
    return same


def dedup_lines_endpoints(lines: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """First of lines with the same ends in either direction."""
    home, reach, like = _end_keys(tolerance)
    return greedy_suppress(lines, [], home, reach, _same_ends(tolerance), like, reads=["project_id", *ENDS])


def _first_known(seq: Column, col: str, empty: Column) -> Column:
    """Value of the earliest (order, value) pair whose value counts."""
    return F.min_by(F.col(col), F.when(~empty, seq))


def fuse_lines(lines: DataFrame, tolerance: float = 5.0, measured: str = "selective_opencv") -> DataFrame:
    """One line per group of duplicates from two sources.

    The group is formed around its first line (semantic source first). Its geometry is that of the last measured
    member, its layer the first that is not ``0``, its line type the last specific one.
    """
    home, reach, like = _end_keys(tolerance)
    first = F.when(F.col("source") == "direct", 0).otherwise(1)
    g = greedy_cluster(lines.withColumn("_rank", first), [F.col("_rank")], home, reach, _same_ends(tolerance), like,
                       reads=["project_id", *ENDS], seed=["id"])
    rows = g.select(F.col("seed.id").alias("id"), F.col("u.project_id").alias("project_id"), F.col("u"), (F.col("u.id") == F.col("seed.id")).alias("own"))
    # members that merely repeat a semantic line change nothing
    rows = rows.where(F.col("own") | (F.col("u.source") == measured))
    seq = F.struct((~F.col("own")).alias("o"), F.col("u._rank").alias("r"), F.col("u.id").alias("i"))
    rows = rows.select("id", "project_id", seq.alias("seq"), "u.x1", "u.y1", "u.x2", "u.y2", "u.layer", "u.linetype", "u.source", "u.confidence")
    plain_layer = F.col("layer").isNull() | F.col("layer").isin("", "0")
    plain_type = F.col("linetype").isNull() | (F.col("linetype") == "Continuous")
    last = lambda c: F.max_by(c, F.col("seq"))
    return rows.groupBy("id", "project_id").agg(
        *[last(F.col(c)).alias(c) for c in (*ENDS, "source", "confidence")],
        F.coalesce(_first_known(F.col("seq"), "layer", plain_layer), last(F.col("layer"))).alias("layer"),
        F.coalesce(F.max_by("linetype", F.when(~plain_type, F.col("seq"))), last(F.col("linetype"))).alias("linetype"),
        F.count(F.lit(1)).alias("members"))


def fuse_circles(circles: DataFrame, tolerance: float = 5.0, measured: str = "selective_opencv") -> DataFrame:
    """The same for circles: centre and radius of the last measured member, first layer that is not ``0``."""
    home, reach = point_keys(("cx", "cy", "radius"), tolerance, ["project_id"])
    same = lambda k, u: (euclid(k, u, ("cx", "cy"), ("cx", "cy")) < tolerance) & (F.abs(k["radius"] - u["radius"]) < tolerance)
    first = F.when(F.col("source") == "direct", 0).otherwise(1)
    g = greedy_cluster(circles.withColumn("_rank", first), [F.col("_rank")], home, reach, same,
                       _tile(("cx", "cy"), tolerance / ROOT2, cell(F.col("radius"), tolerance)),
                       reads=["project_id", "cx", "cy", "radius"], seed=["id"])
    own = F.col("u.id") == F.col("seed.id")
    rows = g.where(own | (F.col("u.source") == measured)).select(
        F.col("seed.id").alias("id"), "u.project_id", F.struct((~own).alias("o"), F.col("u._rank").alias("r"), F.col("u.id").alias("i")).alias("seq"),
        "u.cx", "u.cy", "u.radius", "u.layer", "u.source")
    plain = F.col("layer").isNull() | F.col("layer").isin("", "0")
    last = lambda c: F.max_by(c, F.col("seq"))
    return rows.groupBy("id", "project_id").agg(
        *[last(F.col(c)).alias(c) for c in ("cx", "cy", "radius", "source")],
        F.coalesce(_first_known(F.col("seq"), "layer", plain), last(F.col("layer"))).alias("layer"), F.count(F.lit(1)).alias("members"))


def fuse_entities(entities: DataFrame, tolerance: float = 5.0) -> DataFrame:
    """Lines and circles fused, every other kind passed on."""
    lines = fuse_lines(entities.where("kind = 'line'").select("id", "project_id", *ENDS, "layer", "linetype", "source", "confidence"), tolerance)
    circles = fuse_circles(entities.where("kind = 'circle'").select("id", "project_id", "cx", "cy", "radius", "layer", "source"), tolerance)
    rest = entities.where("kind not in ('line', 'circle')")
    return (lines.withColumn("kind", F.lit("line")).unionByName(circles.withColumn("kind", F.lit("circle")), allowMissingColumns=True)
            .unionByName(rest, allowMissingColumns=True))


def merge_ellipses(ellipses: DataFrame, distance: float = 10.0, ratio: float = 0.2) -> DataFrame:
    """Most confident of each group of like ellipses; groups form around their first member (by id)."""
    home, reach = point_keys(("cx", "cy"), distance, ["project_id"])
    same = lambda k, u: (euclid(k, u, ("cx", "cy"), ("cx", "cy")) < distance) & (
        F.abs(k["semi_major"] - u["semi_major"]) / F.greatest(k["semi_major"], F.lit(1.0)) < ratio)
    like = _tile(("cx", "cy"), distance / ROOT2, F.floor(F.log(F.greatest(F.col("semi_major"), F.lit(1.0))) / math.log(1.0 + ratio)))
    g = greedy_cluster(ellipses, [], home, reach, same, like)
    return g.groupBy(F.col("seed.id").alias("group_id")).agg(
        F.max_by("u", F.struct("u.confidence", -F.col("u.id"))).alias("best"), F.count(F.lit(1)).alias("members")).select("group_id", "best.*", "members")


def merge_junctions(junctions: DataFrame, distance: float = 10.0) -> DataFrame:
    """Weighted mean position, highest confidence and its type per group of near junctions.

    The line ids of a group stay rows of the input; ``seed_id`` in ``junction_groups`` links them.
    """
    g = junction_groups(junctions, distance)
    conf = F.col("u.confidence")
    mean = lambda c: F.when(F.sum(conf) > 0, F.sum(F.col(f"u.{c}") * conf) / F.sum(conf)).otherwise(F.avg(f"u.{c}"))
    return g.groupBy(F.col("seed.id").alias("id"), F.col("seed.project_id").alias("project_id")).agg(
        mean("x").alias("x"), mean("y").alias("y"), F.max(conf).alias("confidence"),
        F.max_by("u.kind", F.struct(conf, -F.col("u.id"))).alias("kind"), F.count(F.lit(1)).alias("members"))


def junction_groups(junctions: DataFrame, distance: float) -> DataFrame:
    home, reach = point_keys(XY, distance, ["project_id"])
    return greedy_cluster(junctions, [], home, reach, lambda k, u: euclid(k, u, XY, XY) < distance, _tile(XY, distance / ROOT2))


def anchor_texts(texts: DataFrame, boxes: DataFrame, min_similarity: float = 0.5, max_offset: float = 200.0) -> DataFrame:
    """Texts (in id order) take their most similar free box within ``max_offset``.

    Similarity is 1 - edit distance / longer length on normalised text. Texts whose lengths alone rule the
    similarity out are dropped before the edit distance is computed.
    """
    norm = lambda df: df.select("id", "project_id", "x", "y", T.normalize_ocr(F.col("text")).alias("t")).withColumn("n", F.length("t"))
    ok = lambda a, b: (F.least(a["n"], b["n"]) >= F.greatest(a["n"], b["n"]) * min_similarity) & (
        T.text_similarity(a["t"], b["t"]) >= min_similarity)
    p = near_pairs(norm(texts), norm(boxes), max_offset, on=["project_id"], where=ok)
    pairs = p.select(F.col("a.id").alias("text_id"), F.col("b.id").alias("box_id"), T.text_similarity(F.col("a.t"), F.col("b.t")).alias("score"))
    return greedy_match(pairs.where("score > 0"), "text_id", "box_id", "score")


def anchor_stats(texts: DataFrame, boxes: DataFrame, matches: DataFrame) -> DataFrame:
    """Match rate, mean offset and the unmatched counts per project."""
    m = matches.join(texts.select(F.col("id").alias("text_id"), "project_id", F.col("x").alias("tx"), F.col("y").alias("ty")), "text_id").join(
        boxes.select(F.col("id").alias("box_id"), F.col("x").alias("bx"), F.col("y").alias("by")), "box_id")
    s = m.groupBy("project_id").agg(F.count(F.lit(1)).alias("anchored"), F.avg(F.hypot(F.col("tx") - F.col("bx"), F.col("ty") - F.col("by"))).alias("mean_offset"))
    n = texts.groupBy("project_id").agg(F.count(F.lit(1)).alias("texts"))
    b = boxes.groupBy("project_id").agg(F.count(F.lit(1)).alias("boxes"))
    out = n.join(b, "project_id", "left").join(s, "project_id", "left").na.fill(0, ["boxes", "anchored"])
    return out.withColumns({"rate": F.col("anchored") / F.col("texts"), "unmatched_texts": F.col("texts") - F.col("anchored"),
                            "unmatched_boxes": F.col("boxes") - F.col("anchored")})
