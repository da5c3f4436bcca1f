"""Proximity and overlap joins as equi-joins on grid cells, followed by the exact test.

All pair tables have two struct columns, ``a`` and ``b``, so predicates are written as ``lambda a, b: ...``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.skew import is_small, salted_join, widen
from planloom.staging import Stage

Pred = Callable[[Column, Column], Column]
WIDEN = 1 + 1e-9
#: Side of a level's cells, in largest boxes of the level: the larger, the fewer cells a box reaches and the more boxes share one.
SIDE = 2.0
#: Rows of the other table in a cell, for each row that looks at it, up to which ``nearest`` needs no rings.
FEW = 16
#: Every second level is used where two tables meet: a row looks at fewer levels, a cell holds boxes of up to four sizes in one.
STEP = 2


def pack(df: DataFrame, name: str) -> DataFrame:
    return df.select(F.struct(*[F.col(c) for c in df.columns]).alias(name))


def cell(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(float(size))).cast("long")


def euclid(a: Column, b: Column, apos: Sequence[str], bpos: Sequence[str]) -> Column:
    total = None
    for p, q in zip(apos, bpos):
        d = a[p] - b[q]
        total = d * d if total is None else total + d * d
    return F.sqrt(total)


def near_pairs(left: DataFrame, right: DataFrame, radius: float, pos: Sequence[str] = ("x", "y"),
               rpos: Sequence[str] | None = None, on: Sequence[str] = (), where: Pred | None = None,
               strict: bool = False) -> DataFrame:
    """Pairs closer than ``radius`` with their ``distance``.

    Cells are two radii wide, so a row of the left side probes two cells per axis and every pair meets in
    exactly one cell. Rows of a crowded right-side cell are spread over tasks.
    """
    rpos = rpos or pos
    home, probe, keys = _point_cells(widen(left), widen(right), radius, pos, rpos, on)
    a, b = F.col("a"), F.col("b")
    dist = euclid(a, b, pos, rpos)
    test = (dist < radius) if strict else (dist <= radius)
    if where is not None:
        test = test & where(a, b)
    return salted_join(home, probe, keys, test, shuffle=True).select("a", "b", dist.alias("distance"))


def _point_cells(left: DataFrame, right: DataFrame, radius: float, pos: Sequence[str], rpos: Sequence[str],
                 on: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """``right`` at its cell, ``left`` at the cells within ``radius``, and the columns in which they meet."""
    size = 2.0 * radius * WIDEN
    names = [f"_c{i}" for i in range(len(pos))]
    keys = [f"_k{i}" for i in range(len(on))] + names
    probe = pack(left, "a").select("a", *[F.col("a")[k].alias(f"_k{i}") for i, k in enumerate(on)])
    home = pack(right, "b").select("b", *[F.col("b")[k].alias(f"_k{i}") for i, k in enumerate(on)],
                                   *[cell(F.col("b")[p], size).alias(n) for p, n in zip(rpos, names)])
    for p, n in zip(pos, names):
        v = F.col("a")[p]
        probe = probe.withColumn(n, F.explode(F.sequence(cell(v - radius * WIDEN, size), cell(v + radius * WIDEN, size))))
    return home, probe, keys


def _crowded(left: DataFrame, right: DataFrame, radius: float, pos: Sequence[str], rpos: Sequence[str], on: Sequence[str]) -> bool:
    """Whether a row of ``left`` meets more than ``FEW`` rows in the cells within ``radius``, on an average."""
    home, probe, keys = _point_cells(left, right, radius, pos, rpos, on)
    both = home.select(*keys, F.lit(1).alias("h"), F.lit(0).alias("p")).unionByName(probe.select(*keys, F.lit(0).alias("h"), F.lit(1).alias("p")))
    met = both.groupBy(*keys).agg(F.sum("h").alias("h"), F.sum("p").alias("p"))
    row = met.agg(F.sum(F.col("h") * F.col("p")).alias("pairs"), F.sum("p").alias("rows")).first()
    return (row["pairs"] or 0) > FEW * (row["rows"] or 0)


def nearest(left: DataFrame, right: DataFrame, radius: float, pos: Sequence[str] = ("x", "y"),
            rpos: Sequence[str] | None = None, on: Sequence[str] = (), lid: str = "id", rid: str = "id",
            where: Pred | None = None, strict: bool = True, rings: Sequence[float] | None = None, distinct: bool = False) -> DataFrame:
    """For each left row the nearest right row within ``radius`` (ties: smallest ``rid``).

    On large and crowded inputs the search runs in growing rings: a row that finds a neighbour in a small ring is done,
    because nothing farther can be nearer, so dense places are settled before a wide ring is tried. Where few rows meet in
    the cells of the whole radius (counted first), rings would only repeat the joins. Without a
    ``where`` test, right rows that agree in everything but the id are reduced to the smallest id first, unless
    the caller knows them to be ``distinct``.

    A ring is joined twice: for the smallest distance of each row, a number that a hash aggregate keeps while pairs pass by,
    and then for the right rows at that distance, of which there are few. So the pairs of a ring are never sorted.
    """
    rpos = rpos or pos
    other = [c for c in right.columns if c != rid]
    if where is None and not distinct:
        right = right.groupBy(*other).agg(F.min(rid).alias(rid)).select(*right.columns)
    if rings is None:
        small = is_small(left) and is_small(right)
        rings = () if small or not _crowded(left, right, radius, pos, rpos, on) else (1 / 64, 1 / 16, 1 / 4)

    def best(rows: DataFrame, r: float) -> DataFrame:
        pairs = near_pairs(rows, right, r, pos, rpos, on, where, strict and r == radius)
        least = pairs.groupBy(*[F.col("a")[c].alias(c) for c in rows.columns]).agg(F.min("distance").alias("_least"))
        at = lambda a, b: euclid(a, b, pos, rpos) == a["_least"]
        test = at if where is None else lambda a, b: at(a, b) & where(a, b)
        pairs = near_pairs(least, right, r, pos, rpos, on, test)
        a = F.struct(*[F.col("a")[c].alias(c) for c in rows.columns])
        order = F.struct(F.col("distance"), F.col("b")[rid].alias("rid"))
        got = F.struct("b", "distance")
        return pairs.groupBy(F.col("a")[lid].alias(lid)).agg(
            F.min_by(F.struct(a.alias("a"), got.alias("got")), order).alias("m")
        ).select("m.a", "m.got.b", "m.got.distance")

    if not rings:
        return best(left, radius)
    stage = Stage(left.sparkSession, "nearest")
    found = None
    rest = left
    for share in rings:
        part = stage.write(best(rest, radius * share))
        found = part if found is None else found.unionByName(part)
        rest = stage.write(rest.join(part.select(F.col("a")[lid].alias(lid)), lid, "left_anti").select(*left.columns))
    return found.unionByName(best(rest, radius))


def box_level(box: Sequence[str], row: Column | None = None, finest: int = 0, step: int = 1) -> Column:
    """Grid level of a box, a multiple of ``step``: no side of it is longer than 2^level. ``box`` names columns or has expressions."""
    g = (lambda c: row[c]) if row is not None else _col
    dims = len(box) // 2
    ext = F.lit(2.0 ** finest)
    for i in range(dims):
        ext = F.greatest(ext, (g(box[dims + i]) - g(box[i])).cast("double"))
    return (F.ceil((F.log2(ext) + 1e-9) / step) * step).cast("int")


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _corner_cells(lo: Column, hi: Column, level: Column, margin: float, most: Column | None = None) -> tuple[Column, Column]:
    """First and last cell in which a box of ``level`` has its lower corner if it meets ``lo`` to ``hi``, widened by ``margin``.
    ``most`` is the longest side of such a box, if less than the level allows."""
    power = F.pow(F.lit(2.0), level)
    most, side = power if most is None else most, power * SIDE
    return F.floor((lo - margin - most) / side).cast("long"), F.floor((hi + margin) / side).cast("long")


def _finest(margin: float) -> int:
    """Cells are never much smaller than the margin, so a probe covers a bounded number of cells per level."""
    return max(-30, math.ceil(math.log2(margin))) if margin > 0 else 0


def boxes_meet(a: Column, b: Column, abox: Sequence[str], bbox: Sequence[str], margin: float = 0.0) -> Column:
    dims = len(abox) // 2
    test = F.lit(True)
    for i in range(dims):
        test = test & (a[abox[i]] - margin <= b[bbox[dims + i]]) & (a[abox[dims + i]] + margin >= b[bbox[i]])
    return test


def _levels(finest: int, *sides: tuple[DataFrame, Sequence[str]]) -> list[int]:
    """Distinct grid levels in use: a logarithmic number of values, whatever the number of rows."""
    seen: set[int] = set()
    for df, box in sides:
        seen |= {r[0] for r in df.select(box_level(box, finest=finest)).distinct().collect() if r[0] is not None}
    return sorted(seen)


def _sizes(finest: int, df: DataFrame, box: Sequence[str], step: int) -> dict[int, list[float]]:
    """Grid levels in use by ``df`` with the longest side of their boxes on each axis: a logarithmic number of values."""
    dims = len(box) // 2
    longest = [F.max((F.col(box[dims + i]) - F.col(box[i])).cast("double")).alias(f"e{i}") for i in range(dims)]
    rows = df.groupBy(box_level(box, finest=finest, step=step).alias("lv")).agg(*longest).collect()
    # the difference of two numbers may be rounded down
    return {r["lv"]: [(r[f"e{i}"] or 0.0) * WIDEN for i in range(dims)] for r in rows if r["lv"] is not None}


def _home(df: DataFrame, name: str, box: Sequence[str], on: Sequence[str], margin: float, step: int) -> DataFrame:
    dims = len(box) // 2
    row = F.col(name)
    # keys that cannot be null: a join would test them for null below the projection, in very long copies of their expressions
    known = lambda c: F.coalesce(c, F.lit(0))
    whole = F.lit(True)
    for c in box:
        whole = whole & F.col(c).isNotNull()
    out = pack(df.where(whole), name).withColumn("_lv", known(box_level(box, row, _finest(margin), step)))
    side = F.pow(F.lit(2.0), F.col("_lv")) * SIDE
    return out.select(name, "_lv", *[row[k].alias(f"_k{i}") for i, k in enumerate(on)],
                      *[known(F.floor(row[box[i]] / side).cast("long")).alias(f"_c{i}") for i in range(dims)])


def _probe(df: DataFrame, name: str, box: Sequence[str], on: Sequence[str], sizes: dict[int, list[float]], margin: float,
           above: bool, step: int) -> DataFrame:
    """``df`` for each cell of the levels ``sizes`` of the other side in which a larger box that meets its box may live."""
    dims = len(box) // 2
    row = F.col(name)
    out = pack(df, name).withColumn("_own", box_level(box, row, _finest(margin), step))
    entry = lambda lv, most: F.struct(F.lit(lv).alias("lv"), *[F.lit(float(m)).alias(f"e{i}") for i, m in enumerate(most)])
    table = F.array(*[entry(lv, sizes[lv]) for lv in sorted(sizes)]) if sizes else F.array(entry(0, [0.0] * dims))
    keep = (lambda v: v["lv"] > F.col("_own")) if above else (lambda v: v["lv"] >= F.col("_own"))
    out = out.withColumn("_s", F.explode(F.filter(table, keep) if sizes else F.filter(table, lambda v: F.lit(False))))
    for i in range(dims):
        lo, hi = _corner_cells(row[box[i]], row[box[dims + i]], F.col("_s.lv"), margin, F.col(f"_s.e{i}"))
        out = out.withColumn(f"_c{i}", F.explode(F.sequence(lo, hi)))
    return out.select(name, "_own", F.col("_s.lv").alias("_lv"), *[row[k].alias(f"_k{i}") for i, k in enumerate(on)],
                      *[f"_c{i}" for i in range(dims)])


def overlap_pairs(left: DataFrame, right: DataFrame, box: Sequence[str], rbox: Sequence[str] | None = None,
                  on: Sequence[str] = (), where: Pred | None = None, margin: float = 0.0, step: int = STEP) -> DataFrame:
    """Pairs whose boxes (widened by ``margin``) meet; every pair is found once.

    Boxes live in the one cell of their own level that holds their lower corner; the smaller box of a pair
    looks the larger one up, so a long box is never copied over many small cells. It looks at levels of the other side only,
    and no farther back than the longest box there reaches. With ``step`` 1 cells are half as wide: for crowded places.
    """
    rbox = rbox or box
    left, right = widen(left), widen(right)
    finest = _finest(margin)
    ups, downs = _sizes(finest, right, rbox, step), _sizes(finest, left, box, step)
    keys = ["_lv"] + [f"_k{i}" for i in range(len(on))] + [f"_c{i}" for i in range(len(box) // 2)]
    a, b = F.col("a"), F.col("b")
    test = boxes_meet(a, b, box, rbox, margin)
    if where is not None:
        test = test & where(a, b)
    up = salted_join(_home(right, "b", rbox, on, margin, step), _probe(left, "a", box, on, ups, margin, False, step), keys, test, shuffle=True)
    down = salted_join(_home(left, "a", box, on, margin, step), _probe(right, "b", rbox, on, downs, margin, True, step), keys, test, shuffle=True)
    return up.select("a", "b").unionByName(down.select("a", "b"))


def overlap_self(df: DataFrame, box: Sequence[str], on: Sequence[str] = (), where: Pred | None = None,
                 margin: float = 0.0, id: str = "id", symmetric: bool = False) -> DataFrame:
    """Unordered pairs of one table whose boxes meet, as ``a.id < b.id``.

    ``where(first, second)`` sees the row with the smaller id first unless it is ``symmetric``.
    """
    df = widen(df)
    sizes = _sizes(_finest(margin), df, box, 1)
    keys = ["_lv"] + [f"_k{i}" for i in range(len(on))] + [f"_c{i}" for i in range(len(box) // 2)]
    p, q = F.col("a"), F.col("b")
    first = F.when(p[id] < q[id], p).otherwise(q)
    second = F.when(p[id] < q[id], q).otherwise(p)
    test = ((F.col("_own") < F.col("_lv")) | (p[id] < q[id])) & boxes_meet(p, q, box, box, margin)
    if where is not None:
        test = test & (where(p, q) if symmetric else
                       ((p[id] < q[id]) & where(p, q)) | ((p[id] > q[id]) & where(q, p)))
    pairs = salted_join(_home(df, "b", box, on, margin, 1), _probe(df, "a", box, on, sizes, margin, False, 1), keys, test, shuffle=True)
    return pairs.select(first.alias("a"), second.alias("b"))


def box_keys(df: DataFrame, box: Sequence[str | Column], on: Sequence[str] = (), margin: float = 0.0) -> tuple[Column, Column]:
    """``(home, reach)`` key arrays for the greedy operators: two rows whose boxes meet share a key."""
    levels = _levels(_finest(margin), (df, box))
    dims = len(box) // 2
    own = box_level(box, finest=_finest(margin))
    keyed = [F.col(k) for k in on]

    def cells(lv: Column, lows: list[Column], highs: list[Column], tag: int) -> Column:
        ranges = [F.sequence(lo, hi) for lo, hi in zip(lows, highs)]
        if dims == 1:
            return F.transform(ranges[0], lambda i: F.xxhash64(F.lit(tag), lv, i, *keyed))
        return F.flatten(F.transform(ranges[0], lambda i: F.transform(
            ranges[1], lambda j: F.xxhash64(F.lit(tag), lv, i, j, *keyed))))

    def at(lv: Column, tag: int, spread: bool) -> Column:
        if not spread:
            base = [F.floor(_col(box[i]) / (F.pow(F.lit(2.0), lv) * SIDE)).cast("long") for i in range(dims)]
            return cells(lv, base, base, tag)
        ranges = [_corner_cells(_col(box[i]), _col(box[dims + i]), lv, margin) for i in range(dims)]
        return cells(lv, [r[0] for r in ranges], [r[1] for r in ranges], tag)

    if len(levels) == 1:
        return at(F.lit(levels[0]), 0, False), at(F.lit(levels[0]), 0, True)
    # boxes of one level meet at the cells of tag 0, a smaller box that comes second at those of tag 1
    table = F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")
    over = lambda keep, tag: F.flatten(F.transform(F.filter(table, keep), lambda v: at(v, tag, True)))
    home = F.concat(at(own, 0, False), over(lambda v: v > own, 1))
    reach = F.concat(F.when(own > F.lit(min(levels, default=0)), at(own, 1, False)).otherwise(F.array().cast("array<long>")), over(lambda v: v >= own, 0))
    return home, reach


def point_keys(pos: Sequence[str | Column], radius: float, on: Sequence[str] = (), cells: float = 2.0,
               radii: Sequence[float] | None = None) -> tuple[Column, Column]:
    """``(home, reach)`` for points: home is one cell (``cells`` radii wide), reach the cells within ``radius``.

    ``radii`` gives each axis a radius of its own.
    """
    keyed = [F.col(k) for k in on]
    axes = [(_col(p), r * WIDEN, cells * r * WIDEN) for p, r in zip(pos, radii or [radius] * len(pos))]
    home = F.xxhash64(*[cell(p, size) for p, _, size in axes], *keyed)
    return home, _grid([F.sequence(cell(p - r, size), cell(p + r, size)) for p, r, size in axes], [], keyed)


def _grid(ranges: list[Column], chosen: list[Column], keyed: list[Column]) -> Column:
    head, rest = ranges[0], ranges[1:]
    if not rest:
        return F.transform(head, lambda i: F.xxhash64(*chosen, i, *keyed))
    return F.flatten(F.transform(head, lambda i: _grid(rest, chosen + [i], keyed)))
