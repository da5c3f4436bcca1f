"""Operators on hand-made drawings and texts."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from planloom.functions import geom
from planloom.functions import text as T
from planloom.functions.intents import ACTIONS, APPS, PATTERNS
from planloom.operators import classify, cleanup, dedup, keyed, relations, rules, texts, vector
from planloom.operators import topology as P
from planloom.sources import entities as E
from planloom.streaming import jobs

LINE = "id long, project_id long, x1 double, y1 double, x2 double, y2 double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_snap_orthogonal_keeps_length(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 1.75), (2, 0, 0.0, 0.0, 50.0, 50.0), (3, 0, 5.0, 5.0, 5.1, -20.0)], LINE)
    out = {r["id"]: r for r in cleanup.snap_orthogonal(df).collect()}
    assert out[1]["y2"] == 0 and math.isclose(out[1]["x2"], math.hypot(100, 1.75))
    assert (out[2]["x2"], out[2]["y2"]) == (50, 50)
    assert out[3]["x2"] == 5 and math.isclose(out[3]["y2"], 5 - math.hypot(0.1, 25))


def test_merge_collinear_gap_and_dashes(spark):
    frag = [(1, 0, 0.0, 0.0, 50.0, 0.0), (2, 0, 60.0, 0.0, 100.0, 0.0), (3, 0, 0.0, 40.0, 10.0, 40.0), (4, 0, 15.0, 40.0, 25.0, 40.0),
            (5, 0, 30.0, 40.0, 40.0, 40.0), (6, 0, 0.0, 80.0, 10.0, 80.0), (7, 0, 200.0, 80.0, 210.0, 80.0)]
    out = {r["id"]: r for r in cleanup.merge_collinear(spark.createDataFrame(frag, LINE)).collect()}
    assert set(out) == {1, 3, 6, 7}
    assert (out[1]["x1"], out[1]["x2"], out[1]["linetype"]) == (0, 100, "CONTINUOUS")
    assert (out[3]["x2"], out[3]["linetype"], out[3]["members"]) == (40, "DASHED", 3)


def test_polylines_chain_loop_and_junction(spark):
    chain = [(i, 0, float(i), 0.0, float(i + 1), 0.0) for i in range(20)]
    chain[5] = (5, 0, 6.0, 0.0, 5.0, 0.0)  # drawn backwards
    loop = [(30, 1, 0.0, 0.0, 9.0, 0.0), (31, 1, 9.0, 0.0, 9.0, 9.0), (32, 1, 9.0, 9.0, 0.0, 9.0), (33, 1, 0.0, 9.0, 0.0, 0.0)]
    star = [(40, 2, 0.0, 0.0, 5.0, 0.0), (41, 2, 0.0, 0.0, 0.0, 5.0), (42, 2, 0.0, 0.0, -5.0, 0.0)]
    lines = spark.createDataFrame(chain + loop + star, LINE)
    walk = cleanup.build_polylines(lines, 0.1)
    w = {}
    for r in walk.orderBy("polyline_id", "seq").collect():
        w.setdefault(r["polyline_id"], []).append(r)
    assert [r["id"] for r in w[0]] == list(range(20)) and [r["reversed"] for r in w[0]].count(True) == 1
    assert len(w[30]) == 4 and all(r["closed"] for r in w[30])
    assert all(len(w[i]) == 1 for i in (40, 41, 42))
    pts = cleanup.polyline_points(lines, walk).where("polyline_id = 0").orderBy("seq").collect()
    assert [r["x"] for r in pts] == [float(i) for i in range(21)]
    assert cleanup.polyline_points(lines, walk).where("polyline_id = 30").count() == 4


def rdp(p, eps):
    (x0, y0), (x1, y1) = p[0][1:], p[-1][1:]
    n = math.hypot(x1 - x0, y1 - y0)
    best, at = 0.0, None
    for i in range(1, len(p) - 1):
        d = abs((p[i][2] - y0) * (x1 - x0) - (p[i][1] - x0) * (y1 - y0)) / n if n else math.hypot(p[i][1] - x0, p[i][2] - y0)
        if d > best:
            best, at = d, i
    if best <= eps:
        return [p[0], p[-1]]
    return rdp(p[: at + 1], eps)[:-1] + rdp(p[at:], eps)


def test_simplify_rdp(spark):
    p = [(i, float(i), round(math.sin(i / 3) * 5 + (i % 4), 3)) for i in range(60)]
    got = cleanup.simplify_rdp(spark.createDataFrame([(1, *r) for r in p], "line long, seq long, x double, y double"), ["line"], 1.5)
    assert [r[0] for r in rows(got.select("seq"))] == [r[0] for r in rdp(p, 1.5)]


def test_refine_drops_duplicates(spark):
    lines = [(1, 0, 0.0, 0.0, 100.0, 1.0), (2, 0, 0.0, 0.02, 100.0, 0.02), (3, 0, 100.3, 0.0, 100.3, 50.0)]
    out, stats = cleanup.refine(spark.createDataFrame(lines, LINE))
    n = {r["step"]: r["n"] for r in stats.collect()}
    assert n["input"] == 3 and n["duplicates"] == out.count() == 2


def test_clip_fraction(spark):
    s = F.struct(F.lit(0.0).alias("x1"), F.lit(0.0).alias("y1"), F.lit(10.0).alias("x2"), F.lit(0.0).alias("y2"))
    f = lambda *b: spark.range(1).select(geom.clip_fraction(s, *[F.lit(float(v)) for v in b])).first()[0]
    assert f(2, -1, 5, 1) == 0.3 and f(-5, -5, 50, 5) == 1.0 and f(2, 3, 5, 4) == 0.0


def test_fuse_lines_keeps_semantic_layer(spark):
    data = [(1, 0, 0.0, 0.0, 10.0, 0.0, "A-WALL", "HIDDEN", "direct", 0.9), (2, 0, 10.2, 0.1, 0.1, 0.0, "0", "Continuous", "selective_opencv", 0.8),
            (3, 0, 50.0, 0.0, 60.0, 0.0, "0", "Continuous", "selective_opencv", 0.8)]
    out = {r["id"]: r for r in dedup.fuse_lines(spark.createDataFrame(data, LINE + ", layer string, linetype string, source string, confidence double"), 1.0).collect()}
    assert set(out) == {1, 3}
    assert (out[1]["x1"], out[1]["layer"], out[1]["linetype"], out[1]["source"]) == (10.2, "A-WALL", "HIDDEN", "selective_opencv")


def test_rooms_and_polygons(spark):
    sq = lambda i, x: (i, 0, [{"x": x, "y": 0.0}, {"x": x + 100, "y": 0.0}, {"x": x + 100, "y": 100.0}, {"x": x, "y": 100.0}])
    rooms = spark.createDataFrame([sq(1, 0.0), sq(2, 103.0), sq(3, 300.0)], "id long, project_id long, boundary array<struct<x:double,y:double>>")
    sym = spark.createDataFrame([(10, 0, 50.0, 50.0, "diffuser"), (11, 0, 150.0, 50.0, "ahu"), (12, 0, 250.0, 50.0, "ahu")],
                                "id long, project_id long, x double, y double, kind string")
    e = rows(relations.containment_edges(rooms, sym).select("relation_type", "from_id", "to_id"))
    assert e == [("contains", 1, 10), ("contains", 2, 11), ("serves", 10, 1)]
    assert rows(relations.rooms_adjacent(rooms).select("room1", "room2")) == [(1, 2)]


def test_recompute_equals_full(spark):
    rng = np.random.default_rng(5)
    mk = lambda s: [(i, i % 2, f"L{i % 9}", *[float(v) for v in rng.uniform(0, 30, 3)]) for i in range(s)]
    def frame(data):
        df = spark.createDataFrame(data, "id long, project_id long, layer string, x double, y double, z double")
        return df.withColumns({"min_x": F.col("x") - 1, "min_y": F.col("y") - 1, "max_x": F.col("x") + 1, "max_y": F.col("y") + 1})
    old = mk(60)
    new = [(*r[:2], "L0", r[3] + 2, *r[4:]) if r[0] % 6 == 0 else r for r in old]
    edges = relations.all_edges(frame(old), 4.0, 8)
    changed, want = spark.createDataFrame([(r[0],) for r in new if r[0] % 6 == 0], "id long"), rows(relations.all_edges(frame(new), 4.0, 8).na.fill(-1.0))
    for before in (None, frame(old)):
        assert rows(relations.recompute_edges(edges, frame(new), changed, 4.0, 8, before).na.fill(-1.0)) == want


def test_annotation_patterns(spark):
    cases = {"ROOM 101": "room_number", "101A": "room_number", "250 SF": "area", "30 m2": "area", "12'-6\"": "dimension", '6"': "dimension",
             "100mm": "dimension", "EL. +12.5": "elevation", "CKT-1A": "circuit_id", "20A/1P": "circuit_id", "VAV-12": "equipment_tag",
             "24x24 SA 200 CFM": "equipment_spec", "24x24": "size", "200 CFM": "flow_rate", '3/4"': "size", "3/4 GV": "equipment_spec",
             "5 HP": "power", "10 TON": "capacity", "(3)": "quantity", "TYP.": "quantity", "A1.01": "sheet_ref", "1/A1.01": "section_ref",
             "SECTION A": "section_ref", "OPEN OFFICE": "room_name", "some free words": "unknown"}
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    got = {r["text"]: r["annotation_type"] for r in texts.parse_annotations(df).collect()}
    assert {k: v for k, v in got.items() if v != cases[k]} == {}


def test_measurements_and_scales(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    m = lambda s: tuple(one(T.measurement(F.lit(s))))
    assert m("20'-0\"") == (240.0, "inches") and m('24"') == (24.0, "inches") and m("100mm") == (100.0, "mm")
    assert m("50 cm") == (500.0, "mm") and m("1.5m") == (1500.0, "mm") and m("24") == (24.0, "inches")
    assert one(T.measurement(F.lit("abc"))) is None
    s = lambda t: tuple(one(T.scale_per_pixel(F.lit(t), F.lit(300.0))))
    assert math.isclose(s("1/4\" = 1'-0\"")[0], 0.16) and math.isclose(s("1:100")[0], 25.4 / 3)
    assert tuple(one(T.sheet_size(F.lit("24 x 36")))) == (24.0, 36.0) and tuple(one(T.sheet_size(F.lit("ANSI B")))) == (11.0, 17.0)


def test_intent(spark):
    df = spark.createDataFrame([(1, "Draw a supply air duct to the vav"), (2, "hello there")], "id long, text string")
    out = {r["id"]: r for r in texts.classify_intent(df, PATTERNS, ACTIONS, APPS).collect()}
    assert (out[1]["domain"], out[1]["subdomain"], out[1]["action"]) == ("hvac", "equipment", "create") and out[1]["confidence"] == 1.0
    assert (out[2]["domain"], out[2]["action"]) == ("general", "query")


def test_upsert_delete_and_expiry(spark):
    ts = dt.datetime(2024, 1, 1)
    t = spark.createDataFrame([(1, "a", 1, ts), (2, "b", 1, None)], "id long, v string, version int, deleted_at timestamp")
    b = spark.createDataFrame([(1, "A", 2, None), (3, "c", 1, None)], "id long, v string, version int, deleted_at timestamp")
    assert rows(keyed.upsert(t, b, ["id"], clear={"deleted_at": None}).select("id", "v")) == [(1, "A"), (2, "b"), (3, "c")]
    now = F.lit("2024-02-01").cast("timestamp")
    d = keyed.soft_delete(t, spark.createDataFrame([(1,), (2,)], "id long"), "id", now)
    assert d.where("deleted_at is null").count() == 0 and d.where("deleted_at = '2024-01-01'").count() == 1
    f = spark.createDataFrame([(1, ts, "x", 0.5), (2, None, "x", 0.5)], "id long, expires_at timestamp, fact_type string, confidence double")
    assert rows(keyed.live_facts(f, now).select("id")) == [(2,)]


def test_vector_join_paths_agree(spark):
    rng = np.random.default_rng(3)
    data = [(i, [float(v) for v in rng.normal(size=8)]) for i in range(90)]
    lib = spark.createDataFrame(data, "id long, embedding array<double>")
    q = lib.select(F.col("id").alias("qid"), F.col("embedding").alias("qvec"))
    a = vector.vector_join(q, lib, 4, exclude_same=True).select("qid", "id", "rn")
    b = vector.vector_join(q, lib, 4, exclude_same=True, max_queries=20, block_rows=25).select("qid", "id", "rn")
    m = np.array([v for _, v in data])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - m @ m.T
    np.fill_diagonal(d, 9)
    want = sorted((i, int(j), r + 1) for i in range(90) for r, j in enumerate(np.argsort(d[i])[:4]))
    assert rows(a) == want and rows(b) == want


def test_session_members(spark):
    t0 = dt.datetime(2024, 1, 1)
    ch = spark.createDataFrame([(1, i, t0 + dt.timedelta(seconds=s)) for i, s in enumerate([0, 1, 2, 10, 11, 30])], "project long, changed_id long, ts timestamp")
    ses = spark.createDataFrame([(1, t0, t0 + dt.timedelta(seconds=7)), (1, t0 + dt.timedelta(seconds=10), t0 + dt.timedelta(seconds=16))],
                                "project long, start timestamp, end timestamp")
    got = jobs.session_members(ch, ses, 5).groupBy("start").agg(F.sort_array(F.collect_list("changed_id")).alias("c"))
    assert sorted(r["c"] for r in got.collect()) == [[0, 1, 2], [3, 4]]


def test_text_or_graphics_blocks(spark):
    data = [(i, 1 if i % 3 else 2, float(i * 7 % 50 + 1), float(i % 30), float(i % 130)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, page long, area double, elongation double, height double")
    a, b = classify.text_or_graphics(df), classify.text_or_graphics(df, blocks=5)
    assert rows(a.na.fill(-1.0)) == rows(b.na.fill(-1.0))


def test_clearance_lookup_either_order(spark):
    e = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, "beam"), (2, 0, 0.06, 0.0, 0.0, "DUCT"), (3, 0, 5.0, 5.0, 0.0, "duct")],
                              "id long, project_id long, x double, y double, z double, category string")
    assert rows(rules.clearance_pairs(e).select("id1", "id2", "required", "severity")) == [(1, 2, 0.15, "error")]


def test_junctions_of_known_angles(spark):
    j = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 100.0, 0.0), (3, 0, 300.0, 300.0)], "id long, project_id long, x double, y double")
    lines = [(1, 0, 0.0, 0.0, 50.0, 0.0), (2, 0, 0.0, 50.0, 0.0, 0.0), (3, 0, 100.0, 0.0, 60.0, 0.0), (4, 0, 100.0, 0.0, 150.0, 0.0), (5, 0, 100.0, 0.0, 100.0, 40.0)]
    out = {r["junction_id"]: r["junction_type"] for r in P.junction_types(j, spark.createDataFrame(lines, LINE), 5.0).collect()}
    assert out == {1: "l_junction", 2: "t_junction", 3: "endpoint"}


def test_readers(spark, tmp_path):
    (tmp_path / "labels" / "val").mkdir(parents=True)
    (tmp_path / "labels" / "val" / "img_7.txt").write_text("3 0.5 0.25 0.1 0.2\nbad line\n")
    assert rows(E.read_labels(spark, str(tmp_path / "labels"))) == [("img_7", "val", 3, 0.5, 0.25, 0.1, 0.2)]
    assert E.file_manifest(spark, str(tmp_path / "labels" / "val"), content_hash=True).count() == 1
    doc = '{"lines":[{"x1":0,"y1":0,"x2":10,"y2":0,"kind":"wall","linetype":"dashed"}],"text":[{"x":5,"y":5,"height":10,"content":"A","kind":"note"}]}'
    from planloom.functions import naming
    d = spark.createDataFrame([(1, doc, 0.5, 0.0, 0.0, 100.0)], "doc_id long, doc string, scale double, origin_x double, origin_y double, height double")
    out = E.explode_analysis(d, naming.layer_for, naming.text_layer_for, naming.symbol_layer_for).orderBy("pos").collect()
    assert (out[0]["entity_kind"], out[0]["layer"], out[0]["x2"], out[0]["y1"], out[0]["linetype"]) == ("line", "A-WALL", 5.0, 50.0, "HIDDEN")
    assert (out[1]["entity_kind"], out[1]["layer"], out[1]["text"]) == ("mtext", "G-ANNO-NOTE", "A")


def test_standards_by_hand(spark):
    from planloom.operators import standards

    e = spark.createDataFrame([(1, 0, "Smoke Detector", "photoelectric", None), (2, 0, "speaker", None, None), (3, 0, "valve", "gate", "2in"), (4, 0, "sprinkler", "upright", None),
                               (5, 0, "camera", "ptz", None), (6, 0, "valve", None, None)], "id long, project_id long, element_type string, subtype string, size string")
    std = spark.createDataFrame([("plumbing", "valve", None, "X", "X"), ("plumbing", "valve", "default", "B", "B2"), ("plumbing", "valve", "default", "B", "B1")],
                                "discipline string, element_type string, subtype string, layer string, block string")
    none = std.limit(0)
    out = {r["id"]: r for r in standards.standards_lookup(e, none, none, std).collect()}
    assert (out[1]["layer"], out[1]["block"], out[1]["attributes"]) == ("F-ALRM-DETC", "F-DETC-SMOK-P", {"ZONE": "", "ADDRESS": "", "TAG": ""})
    assert (out[2]["system"], out[2]["layer"], out[2]["color"], out[2]["block"]) == ("audio_visual", "T-AUDV-AUDV", 6, "T-AUDV-SPKR")
    assert (out[3]["layer"], out[3]["block"], out[3]["attributes"]["SIZE"], out[3]["source"]) == ("B", "B1", "2in", "file")
    assert (out[4]["layer"], out[4]["block"], out[5]["layer"], out[5]["block"]) == ("F-SPKL-SPKL", "F-SPKL-UPR", "T-SECR-SECU", "T-SECU-CAM-PTZ")
    assert standards.coverage_stats(standards.standards_lookup(e.limit(0), none, none, std)).first()["coverage_percent"] == 0


def test_drawing_types_by_hand(spark):
    sheets = {"DOOR SCHEDULE": "schedule", "structural framing": "structural", "legend symbols": "legend", "MEP combined": "mep_plan", "civil grading": "site_plan",
              "vertical diagram of stacks": "riser_diagram", "typ. wall detail": "detail", "hello": "unknown"}
    df = spark.createDataFrame([(k, v) for k, v in sheets.items()], "text string, want string")
    assert all(r["drawing_type"] == r["want"] for r in texts.classify_documents(df).collect())


def test_action_words_by_hand(spark):
    asked = {"route the duct to room 5": "route", "tally the valves": "schedule", "is there a clash or a collision": "coordinate", "audit the report": "analyze", "hm": "query"}
    df = spark.createDataFrame([(k, v) for k, v in asked.items()], "text string, want string")
    assert all(r["action"] == r["want"] for r in texts.classify_intent(df, PATTERNS, ACTIONS, APPS).collect())


def test_repeated_keys_and_zero_vectors(spark):
    table = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, status string, version int")
    batch = spark.createDataFrame([(2, "c", 2), (3, "d", 2), (3, "e", 3)], "id long, status string, version int")
    assert rows(keyed.insert_ignore(table, batch, ["id"])) == [(1, "a", 1), (2, "b", 1), (3, "d", 2)]
    assert rows(keyed.upsert(table, batch, ["id"])) == [(1, "a", 1), (2, "c", 2), (3, "e", 3)]
    assert rows(keyed.set_status(table, spark.createDataFrame([(1, "x"), (1, "y")], "id long, status string"))) == [(1, "y", 1), (2, "b", 1)]
    entities = spark.createDataFrame([("h", 1, 1)], "handle string, x int, y int")
    fixes = spark.createDataFrame([(1, "modify", "h", 5, 5), (2, "modify", "h", 6, None)], "correction_id int, action string, handle string, x int, y int")
    assert rows(keyed.apply_corrections(entities, fixes)[0]) == [("h", 6, 5)]
    vectors = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<double>")
    query = spark.createDataFrame([([1.0, 0.0],)], "qvec array<double>")
    assert [(r["id"], r["distance"]) for r in vector.vector_topk(vectors, query, 2).collect()] == [(2, 0.0), (1, 1.0)]
    assert spark.range(1).select(T.scale_per_pixel(F.lit("1/0\" = 1'-0\""), F.lit(300.0))["value"].alias("v")).first()["v"] is None


def test_exploded_rows_are_not_broadcast(spark, tmp_path):
    """Ids in order take next to nothing in a file: the optimizer would broadcast the cells of all of them."""
    spark.range(2000).selectExpr("id", "id div 100 project_id", "cast(id % 10 as double) x", "cast(id % 7 as double) y").write.parquet(str(tmp_path / "p"))
    p = spark.read.parquet(str(tmp_path / "p"))
    box = p.selectExpr("id", "project_id", "x - 1 min_x", "y - 1 min_y", "x + 1 max_x", "y + 1 max_y")
    near = relations.spacing_violations(p, 1.5)
    edges = box.select("project_id", F.col("id").alias("from_id"), F.col("id").alias("to_id"), F.lit("near").alias("relation_type"), F.lit(0.0).alias("distance"))
    for df in (near, relations.intersecting_pairs(box), relations.contains_bbox(p.selectExpr(
            "id", "project_id", "array(struct(x, y), struct(x + 1 as x, y), struct(x + 1 as x, y + 1 as y)) boundary"), p),
            relations.related(edges, p)):
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_parallel_pairs_against_all_pairs(spark):
    """Long slanted lines and exact spacings; boxes along the axes lose pairs of lines that run apart."""
    import random
    r, lines = random.Random(5), []
    for i in range(240):
        x, y, a = r.uniform(-200, 400), r.uniform(-100, 300), math.radians(r.choice([0, 90, r.uniform(0, 360), r.gauss(180, 9), r.gauss(270, 9)]))
        n = r.choice([r.uniform(1, 40), r.uniform(800, 3000)])
        lines.append((i, 0, x, y, x + n * math.cos(a), y + n * math.sin(a)))
    lines += [(240 + i, 0, 36.0 * (i % 5), 36.0 * (i // 5), 36.0 * (i % 5) + 30.0, 36.0 * (i // 5)) for i in range(25)]

    def faces(p, q, tol, high):
        (ax, ay, bx, by), (cx, cy, dx, dy) = p[2:], q[2:]
        n, m = math.hypot(bx - ax, by - ay), math.hypot(dx - cx, dy - cy)
        ux, uy = (bx - ax) / n, (by - ay) / n
        turn = abs(math.degrees(math.atan2(by - ay, bx - ax)) % 360 - math.degrees(math.atan2(dy - cy, dx - cx)) % 360)
        t1, t2 = (cx - ax) * ux + (cy - ay) * uy, (dx - ax) * ux + (dy - ay) * uy
        gap = abs(((cy + dy) / 2 - ay) * ux - ((cx + dx) / 2 - ax) * uy)
        shared = min(n, max(t1, t2)) - max(0.0, min(t1, t2))
        return min(turn, abs(turn - 180), 360 - turn) <= tol and 1 <= gap <= high and shared > min(n, abs(t2 - t1)) * 0.3

    df = spark.createDataFrame(lines, LINE)
    for tol, high in ((3.0, 72.0), (40.0, 30.0)):
        want = {(p[0], q[0]) for p in lines for q in lines if p[0] < q[0] and faces(p, q, tol, high)}
        got = [(x.id1, x.id2) for x in relations.parallel_pairs(df, tol, high=high).collect()]
        assert len(got) == len(set(got)) and set(got) == want
