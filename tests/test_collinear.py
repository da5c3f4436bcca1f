import math
import random

from pyspark.sql import functions as F

from planloom.operators import cleanup, spatial

LINE = "id long, project_id long, x1 double, y1 double, x2 double, y2 double"


def plain(lines, distance, gap):
    """First line of each cluster, by a scan that joins a line to the first one whose track and interval are near."""
    seeds, home = [], {}
    for i, p, x1, y1, x2, y2 in sorted(lines):
        bucket = round(math.degrees(math.atan2(y2 - y1, x2 - x1)) % 180.0)
        for j, q, b, kx, ky, ux, uy, n in seeds:
            t = sorted((x - kx) * ux + (y - ky) * uy for x, y in ((x1, y1), (x2, y2)))
            if (p, bucket) == (q, b) and abs((x1 - kx) * -uy + (y1 - ky) * ux) <= distance and max(t[0] - n, -t[1]) <= gap:
                home[i] = j
                break
        else:
            n = math.dist((x1, y1), (x2, y2))
            seeds.append((i, p, bucket, x1, y1, (x2 - x1) / n, (y2 - y1) / n, n))
            home[i] = i
    return {(j, list(home.values()).count(j)) for j in home.values()}


def test_merged_lines_equal_a_plain_scan(spark):
    rng = random.Random(8)
    lines = []
    for i in range(700):
        x, y, n = rng.uniform(-200, 200), rng.uniform(-200, 200), rng.choice([0.5, 5, 40, 300])
        a = math.radians(rng.choice([0, 90, 37, 179.8, 45]) + rng.uniform(-0.49, 0.49))
        lines.append((i, i % 2, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    df = spark.createDataFrame(lines, LINE)
    for distance, gap in ((5.0, 20.0), (20.0, 1.0), (0.5, 60.0)):
        got = {(r.id, r.members) for r in cleanup.merge_collinear(df, distance, gap).collect()}
        want = plain(lines, distance, gap)
        assert got == want and len(want) < 690


def test_fragments_meet_those_on_their_track(spark, monkeypatch):
    """Parallel lines ten apart are no candidates of all lines within the gap."""
    seen, cluster = [], cleanup.greedy_cluster

    def counted(rows, order, home, reach, *rest, **more):
        keyed = lambda k, name: rows.select(F.col("id").alias(name), F.explode(k).alias("k"))
        seen.append(keyed(home, "a").join(keyed(reach, "b"), "k").count())
        return cluster(rows, order, home, reach, *rest, **more)

    monkeypatch.setattr(cleanup, "greedy_cluster", counted)
    df = spark.createDataFrame([(i * 50 + k, 0, k * 40.0, i * 10.0, k * 40.0 + 20.0, i * 10.0) for i in range(50) for k in range(50)], LINE)
    assert cleanup.merge_collinear(df).count() == 25 * 50
    assert seen[0] < 60 * 2500


def test_rings_only_where_rows_crowd(spark, monkeypatch):
    """Large inputs of few rows in reach are searched once, crowded ones in rings, with the same result."""
    monkeypatch.setattr(spatial, "is_small", lambda df, limit=None: False)
    staged = []
    stage = spatial.Stage
    monkeypatch.setattr(spatial, "Stage", lambda *a: staged.append(a) or stage(*a))
    rng = random.Random(2)
    for side, rings in ((100.0, 0), (2.0, 1)):
        pts = [(i, round(rng.uniform(0, side), 3), round(rng.uniform(0, side), 3)) for i in range(300)]
        a, b = (spark.createDataFrame(p, "id long, x double, y double") for p in (pts[:100], pts[100:]))
        got = {(r.i, r.j) for r in spatial.nearest(a, b, 5.0).select(F.col("a.id").alias("i"), F.col("b.id").alias("j")).collect()}
        want = {}
        for i, x, y in pts[:100]:
            d, j = min((math.sqrt((x - u) ** 2 + (y - v) ** 2), j) for j, u, v in pts[100:])
            if d < 5.0:
                want[i] = j
        assert got == set(want.items()) and len(staged) == rings
