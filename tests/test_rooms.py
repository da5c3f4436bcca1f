import math
import random

from planloom.operators import relations

ROOM = "id long, project_id long, boundary array<struct<x:double,y:double>>"


def plain(rooms, tolerance):
    """Every side with every side of a later room of the project."""
    sides = [(i, p, *a, *b) for i, p, pts in rooms for a, b in zip(pts, pts[1:] + pts[:1]) if math.dist(a, b) >= 1.0]
    out = set()
    for i, p, ax, ay, bx, by in sides:
        ln = math.dist((ax, ay), (bx, by))
        ux, uy = (bx - ax) / ln, (by - ay) / ln
        for j, q, cx, cy, dx, dy in sides:
            if p != q or i >= j:
                continue
            m = math.dist((cx, cy), (dx, dy))
            s, t = sorted((ax * ux + ay * uy, bx * ux + by * uy)), sorted((cx * ux + cy * uy, dx * ux + dy * uy))
            shared = min(s[1], t[1]) - max(s[0], t[0])
            if (abs(ux * (dy - cy) / m - uy * (dx - cx) / m) <= 0.1 and abs((cy - ay) * ux - (cx - ax) * uy) <= tolerance
                    and shared > 0.1 * min(s[1] - s[0], t[1] - t[0])):
                out.add((p, i, j))
    return out


def test_rooms_of_any_shape_equal_a_plain_search(spark):
    rng = random.Random(3)
    rooms = []
    for i in range(300):
        x, y, n, size = rng.uniform(-150, 150), rng.uniform(-150, 150), rng.randrange(3, 8), rng.choice([3, 20, 60, 200])
        turn = rng.uniform(0, 2 * math.pi)
        pts = [(x + size * math.cos(turn + 2 * math.pi * k / n), y + size * rng.uniform(0.9, 1.1) * math.sin(turn + 2 * math.pi * k / n)) for k in range(n)]
        rooms.append((i, i % 2, pts))
    df = spark.createDataFrame([(i, p, [{"x": x, "y": y} for x, y in pts]) for i, p, pts in rooms], ROOM)
    for tolerance in (5.0, 0.5):
        want = plain(rooms, tolerance)
        got = [tuple(r) for r in relations.rooms_adjacent(df, tolerance).select("project_id", "room1", "room2").collect()]
        assert set(got) == want and len(got) == len(want) > 20


def test_sides_meet_few_others(spark, monkeypatch):
    """In a plan of 8 by 5 rooms a side is tested with those around it, not with most sides of the drawing."""
    met, pairs = [], relations.overlap_pairs

    def counted(left, right, *rest, where=None, **more):
        met.append(pairs(left, right, *rest, **more).where("a.id < b.id").count())
        return pairs(left, right, *rest, where=where, **more)

    monkeypatch.setattr(relations, "overlap_pairs", counted)
    at = lambda i, x, y: (i, 0, [{"x": x, "y": y}, {"x": x + 25.0, "y": y}, {"x": x + 25.0, "y": y + 40.0}, {"x": x, "y": y + 40.0}])
    df = spark.createDataFrame([at(i, i % 8 * 25.0, i // 8 * 40.0) for i in range(40)], ROOM)
    got = {(r.room1, r.room2) for r in relations.rooms_adjacent(df).collect()}
    assert got == {(i, i + 1) for i in range(40) if i % 8 < 7} | {(i, i + 8) for i in range(32)}
    assert met[0] <= 3 * 160
