"""The same operators with every salted path forced on: one key holds a third of the rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planloom import skew
from planloom.operators import cleanup, dedup, graph, greedy, relations, texts
from planloom.operators.spatial import near_pairs

REAL = skew.hot_keys


@pytest.fixture(autouse=True)
def forced(monkeypatch):
    used = []

    def hot(df, keys, *a, **k):
        found = REAL(df, keys, sample=1.0, rows_per_task=4, small_bytes=0)
        used.append(len(found))
        return found

    for module in (skew, greedy, graph):
        monkeypatch.setattr(module, "hot_keys", hot)
    yield used
    assert any(used), "no hot key was salted"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def data(n=90):
    rnd = random.Random(11)
    return [(i, 0 if i % 3 else i % 4, *((20.0 + rnd.randrange(9) / 10, 20.0) if i % 3 == 0 else (float(rnd.randrange(40)), float(rnd.randrange(40)))),
             rnd.randrange(10) / 10) for i in range(n)]


def frame(spark, d):
    return spark.createDataFrame(d, "id long, project_id long, x double, y double, confidence double")


def test_near_pairs(spark):
    d = data()
    df = frame(spark, d)
    want = sorted((p[0], q[0]) for p in d for q in d if p[1] == q[1] and p[0] < q[0] and math.hypot(p[2] - q[2], p[3] - q[3]) <= 4)
    assert rows(near_pairs(df, df, 4.0, on=["project_id"], where=lambda a, b: a["id"] < b["id"]).select("a.id", "b.id")) == want


def test_greedy(spark):
    d = data()
    kept = []
    for p in sorted(d, key=lambda r: (-r[4], r[0])):
        if not any(k[1] == p[1] and math.hypot(k[2] - p[2], k[3] - p[3]) < 6 for k in kept):
            kept.append(p)
    assert rows(dedup.nms_distance(frame(spark, d), 6.0).select("id")) == sorted((k[0],) for k in kept)


def test_components_with_a_hub(spark):
    e = spark.createDataFrame([(0, i) for i in range(1, 30)] + [(100 + i, 101 + i) for i in range(15)], "a long, b long")
    got = graph.components(e.select(F.col("a").alias("node")), e).groupBy("component").count()
    assert rows(got) == [(0, 30), (100, 16)]


def test_rdp_and_rooms(spark):
    p = [(1, i, float(i), float(i % 7)) for i in range(60)]
    pts = spark.createDataFrame(p, "line long, seq long, x double, y double")
    assert cleanup.simplify_rdp(pts, ["line"], 0.01).where("seq in (0, 59)").count() == 2
    a = spark.createDataFrame([(i, 0, 5.0, 5.0, f"ROOM {i}") for i in range(40)], "id long, project_id long, x double, y double, text string")
    rooms = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0)], "id long, project_id long, min_x double, min_y double, max_x double, max_y double")
    r = texts.room_annotations(texts.parse_annotations(a), rooms).first()
    assert (r["number"], r["n_texts"]) == ("39", 40)


def test_layer_pairs(spark):
    e = spark.createDataFrame([(i, 0, "BIG" if i % 3 else f"L{i % 5}") for i in range(60)], "id long, project_id long, layer string")
    got = relations.on_layer_pairs(e, 10)
    assert got.count() == sum(n * (n - 1) // 2 for n in [4] * 5)
