"""Joins, ordered columns, greedy rounds and graphs against brute force on random fixtures, with forced skew."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planloom import ordered, skew
from planloom.operators import graph as G
from planloom.operators import dedup, greedy
from planloom.operators import spatial as S
from planloom.operators.greedy import greedy_cluster, greedy_match, greedy_suppress

BOX = ("min_x", "min_y", "max_x", "max_y")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    many = spark.range(500).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 11).alias("k"), F.col("id").alias("v"))
    few = spark.createDataFrame([(7, "a"), (7, "b"), (3, "c"), (20, "d")], "k long, w string")
    hot = [(7, 5), (3, 2)]
    assert rows(skew.salted_join(many, few, ["k"], how=how, hot=hot)) == rows(many.join(few, "k", how))


def test_salted_join_with_condition(spark):
    many = spark.range(300).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    few = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("w"))
    got = skew.salted_join(many, few, ["k"], F.col("v") < F.col("w"), hot=[(1, 4)]).select("k", "v", "w")
    want = many.join(few, "k").where("v < w").select("k", "v", "w")
    assert rows(got) == rows(want)


def test_hot_keys_finds_the_key_with_a_third_of_the_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"))
    hot = skew.hot_keys(df, ["k"], sample=0.2, rows_per_task=1000, small_bytes=0)
    assert [h[0] for h in hot] == [1] and hot[0][1] >= 5


def test_join_all_paths_agree(spark):
    many, few = spark.range(50).toDF("a"), spark.range(7).toDF("b")
    small, large = skew.join_all(many, few), skew.join_all(many, few, max_rows=3, spread=4)
    assert rows(small.select("a", "b")) == rows(large.select("a", "b")) and small.count() == 350


def test_blocked_order_equals_window(spark):
    rnd = random.Random(1)
    data = [("hot" if i % 3 else str(i % 5), rnd.randrange(1000), i, rnd.randrange(9)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, t int, id int, v int")
    o = [F.col("t"), F.col("id")]
    for fn in (lambda b: ordered.running_sum(df, ["g"], o, F.col("v"), "s", b).select("id", "s"),
               lambda b: ordered.row_index(df, ["g"], o, "i", b).select("id", "i"),
               lambda b: ordered.previous(df, ["g"], o, {"p": "v"}, b).select("id", "p").na.fill(-1),
               lambda b: ordered.running_max(df, ["g"], o, "v", "m", b).select("id", "m").na.fill(-1),
               lambda b: ordered.middle_value(df, ["g"], "t", "id", "med", b)):
        assert rows(fn(None)) == rows(fn(6))


def points(spark, n, seed, dense=False):
    rnd = random.Random(seed)
    data = []
    for i in range(n):
        if dense and i % 3 == 0:
            data.append((i, 0, 50 + rnd.randrange(5) / 100, 50.0, rnd.randrange(10) / 10))
        else:
            data.append((i, i % 2, float(rnd.randrange(60)), float(rnd.randrange(60)), rnd.randrange(10) / 10))
    return data, spark.createDataFrame(data, "id long, project_id long, x double, y double, confidence double")


def test_near_pairs_and_nearest(spark):
    data, df = points(spark, 120, 2, dense=True)
    d = lambda p, q: math.hypot(p[2] - q[2], p[3] - q[3])
    want = sorted((p[0], q[0]) for p in data for q in data if p[1] == q[1] and p[0] != q[0] and d(p, q) <= 5)
    got = S.near_pairs(df, df, 5.0, on=["project_id"], where=lambda a, b: a["id"] != b["id"])
    assert rows(got.select("a.id", "b.id")) == want
    best = {}
    for p in data:
        c = [(d(p, q), q[0]) for q in data if p[1] == q[1] and q[0] != p[0] and d(p, q) < 9]
        if c:
            best[p[0]] = min(c)[1]
    for rings in ((), (0.1, 0.5)):
        hit = S.nearest(df, df.drop("confidence"), 9.0, on=["project_id"], where=lambda a, b: a["id"] != b["id"], rings=rings)
        got = {r[0]: r[1] for r in hit.select("a.id", "b.id").collect()}
        assert got.keys() == best.keys()
        by = {p[0]: p for p in data}
        assert all(abs(d(by[k], by[v]) - d(by[k], by[best[k]])) < 1e-9 for k, v in got.items())


def test_overlap_pairs_of_mixed_sizes(spark):
    rnd = random.Random(3)
    data = []
    for i in range(150):
        x, y, w = rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0.0, 0.5, 3, 20, 90])
        data.append((i, i % 2, x, y, x + w, y + rnd.choice([0.0, 1, w])))
    df = spark.createDataFrame(data, "id long, project_id long, min_x double, min_y double, max_x double, max_y double")
    for m in (0.0, 4.0):
        meet = lambda p, q: p[1] == q[1] and p[2] - m <= q[4] and p[4] + m >= q[2] and p[3] - m <= q[5] and p[5] + m >= q[3]  # noqa: E731,B023
        want = sorted((p[0], q[0]) for p in data for q in data if p[0] < q[0] and meet(p, q))
        assert rows(S.overlap_self(df, BOX, ["project_id"], margin=m).select("a.id", "b.id")) == want
        both = sorted((p[0], q[0]) for p in data for q in data if meet(p, q))
        assert rows(S.overlap_pairs(df, df, BOX, on=["project_id"], margin=m).select("a.id", "b.id")) == both


@pytest.mark.parametrize("few", [64, -1])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_greedy_equals_the_sequential_scan(spark, monkeypatch, seed, few):
    monkeypatch.setattr(greedy, "FEW", few)  # -1: rounds over cliques to the end
    data, df = points(spark, 150, seed, dense=True)
    kept, seed_of = [], {}
    for p in sorted(data, key=lambda r: (-r[4], r[0])):
        hit = [k for k in kept if k[1] == p[1] and math.hypot(k[2] - p[2], k[3] - p[3]) < 7]
        seed_of[p[0]] = hit[0][0] if hit else p[0]
        if not hit:
            kept.append(p)
    home, reach = S.point_keys(("x", "y"), 7.0, ["project_id"])
    near = lambda k, u: S.euclid(k, u, ("x", "y"), ("x", "y")) < 7.0
    tile = [F.col("project_id"), S.cell(F.col("x"), 4.9), S.cell(F.col("y"), 4.9)]
    got = greedy_suppress(df, [-F.col("confidence")], home, reach, near, tile)
    assert rows(got.select("id")) == sorted((k[0],) for k in kept)
    g = greedy_cluster(df.repartition(5), [-F.col("confidence")], home, reach, near, tile)
    assert {r[0]: r[1] for r in g.select("u.id", "seed.id").collect()} == seed_of


@pytest.mark.parametrize("seed", [1, 2])
def test_greedy_match_equals_the_sequential_scan(spark, seed):
    rnd = random.Random(seed)
    pairs = [(a, b, rnd.randrange(5) / 5) for a in range(25) for b in range(25) if rnd.random() < 0.3]
    used, want = set(), []
    for a in range(25):
        c = [(-s, b) for x, b, s in pairs if x == a and b not in used]
        if c:
            s, b = min(c)
            used.add(b)
            want.append((a, b, -s))
    got = greedy_match(spark.createDataFrame(pairs, "a long, b long, s double"), "a", "b", "s")
    assert rows(got) == sorted(want)


def test_components_and_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(0, n) for n in range(200, 230)]
    df = spark.createDataFrame(edges, "a long, b long")
    nodes = spark.createDataFrame([(999,)], "node long")
    got = {r["node"]: r["component"] for r in G.components(nodes, df).collect()}
    assert got[40] == 0 and got[229] == 0 and got[102] == 100 and got[999] == 999
    seeds = spark.createDataFrame([(1, 40)], "seed long, node long")
    lv = {r["node"]: (r["hop"], r["path"]) for r in G.levels(G.Arcs(G.adjacency(df)), seeds, None, paths=True).collect()}
    assert lv[0][0] == 40 and lv[0][1] == list(range(40, -1, -1))
    ap = G.all_paths(G.Arcs(G.adjacency(spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "a long, b long"))), 1, 4, 4)
    assert rows(ap.select(F.concat_ws("-", "path"))) == [("1-2-3-4",), ("1-3-4",)]


def test_pair_order_does_not_change_results(spark):
    data, df = points(spark, 60, 9)
    a = S.near_pairs(df, df, 6.0, on=["project_id"]).select("a.id", "b.id")
    b = S.near_pairs(df.orderBy(F.desc("id")), df.repartition(7), 6.0, on=["project_id"]).select("a.id", "b.id")
    assert rows(a) == rows(b)


@pytest.mark.parametrize("block", [20_000, 7])
def test_greedy_chain_takes_a_round_for_each_block(spark, monkeypatch, block):
    """A chain of 60 rows, each in conflict with the two before it: the scan keeps every third."""
    monkeypatch.setattr(greedy, "BLOCK", block)
    rounds = []
    write = greedy.Stage.write
    monkeypatch.setattr(greedy.Stage, "write", lambda self, df: rounds.append(df.columns) or write(self, df))
    df = spark.createDataFrame([(k, 1, k * 1.0, 0.0) for k in range(60)], "id long, project_id long, x double, y double")
    home, reach = S.point_keys(("x", "y"), 2.5, ["project_id"])
    near = lambda k, u: S.euclid(k, u, ("x", "y"), ("x", "y")) < 2.5
    kept = greedy_suppress(df.repartition(4), [], home, reach, near, [F.col("project_id"), F.floor(F.col("x") / 1.5)])
    assert sorted(r.id for r in kept.collect()) == list(range(0, 60, 3))
    assert sum(c == ["n", "kept"] for c in rounds) <= -(-60 // block)


def keyed(df, home, reach):
    one = home if df.select(home.alias("h")).schema["h"].dataType.typeName() == "array" else F.array(home)
    return {r[0]: (set(r[1]), set(r[2])) for r in df.select("id", one, reach).collect()}


def test_keys_of_line_ends_are_few_and_complete(spark):
    """F13, F16 to F19, F25: a line was repeated for 33 keys; now for fewer than five on average, in either direction."""
    rnd = random.Random(5)
    lines = []
    for i in range(0, 300, 2):
        a, b = (rnd.uniform(0, 60), rnd.uniform(0, 60)), (rnd.uniform(0, 60), rnd.uniform(0, 60))
        near = [tuple(v + rnd.uniform(-8, 8) for v in p) for p in (a, b)]
        lines += [(i, 0, *a, *b), (i + 1, 0, *near[i % 4 // 2], *near[1 - i % 4 // 2])]
    df = spark.createDataFrame(lines, "id long, project_id int, x1 double, y1 double, x2 double, y2 double")
    home, reach, _ = dedup._end_keys(12.0)
    keys = keyed(df, home, reach)
    d = lambda p, q, i, j: math.hypot(p[i] - q[j], p[i + 1] - q[j + 1]) < 12
    same = {(p[0], q[0]) for p in lines for q in lines if (d(p, q, 2, 2) and d(p, q, 4, 4)) or (d(p, q, 2, 4) and d(p, q, 4, 2))}
    assert len(same) > 500 and all(keys[p][0] & keys[q][1] for p, q in same)
    assert sum(len(h) + len(r) for h, r in keys.values()) < 33 / 4 * len(lines)


def test_keys_of_boxes_are_few_and_complete(spark):
    """boxes of three sizes, and no more than a third of the keys of cells as small as the boxes."""
    rnd = random.Random(6)
    boxes = []
    for i in range(200):
        x, y, w, h = rnd.uniform(0, 300), rnd.uniform(0, 300), *(rnd.uniform(0, rnd.choice([20, 60, 120])) for _ in range(2))
        boxes.append((i, 0, x, y, x + w, y + h))
    df = spark.createDataFrame(boxes, "id long, project_id int, min_x double, min_y double, max_x double, max_y double")
    keys = keyed(df, *S.box_keys(df, BOX, ["project_id"], margin=20.0))
    meet = lambda a, b: all(a[i] - 20 <= b[i + 2] and a[i + 2] + 20 >= b[i] for i in (2, 3))
    assert all(keys[a[0]][0] & keys[b[0]][1] for a in boxes for b in boxes if meet(a, b))
    assert sum(len(h) + len(r) for h, r in keys.values()) < 25 * len(boxes)


@pytest.mark.parametrize("few", [512, -1])
def test_only_the_columns_that_are_read_travel(spark, monkeypatch, few):
    monkeypatch.setattr(greedy, "FEW", few)
    written = []
    write = greedy.Stage.write
    monkeypatch.setattr(greedy.Stage, "write", lambda self, df: written.append(df.schema) or write(self, df))
    data, df = points(spark, 100, 4, dense=True)
    df = df.withColumn("note", F.concat(F.lit("n"), "id"))
    home, reach = S.point_keys(("x", "y"), 7.0, ["project_id"])
    near = lambda k, u: S.euclid(k, u, ("x", "y"), ("x", "y")) < 7.0
    how = ([-F.col("confidence")], home, reach, near)
    full = {r[0]: r[1] for r in greedy_cluster(df, *how).select("u.id", "seed.id").collect()}
    written.clear()
    g = greedy_cluster(df, *how, reads=["project_id", "x", "y"], seed=["id"])
    assert {r[0]: (r[1], r[2]) for r in g.select("u.id", "seed.id", "u.note").collect()} == {i: (s, f"n{i}") for i, s in full.items()}
    kept = greedy_suppress(df, *how, reads=["project_id", "x", "y"])
    assert rows(kept.select("id", "note")) == sorted((i, f"n{i}") for i, s in full.items() if i == s)
    assert written and not any("note" in s.simpleString() for s in written)
