import numpy as np
from pyspark.sql import functions as F

from planloom.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, tokens int, _p string, row int"


def rows():
    rng = np.random.default_rng(2)
    out = []
    for k in range(3000):
        source, lang = rng.choice(["a", "b", "c"], p=[0.7, 0.2, 0.1]), rng.choice(["en", "de"], p=[0.8, 0.2])
        text = " ".join(["word"] * int(rng.integers(1, 40))) + rng.choice(["", "\n" * 9, " #$% @@ ##"], p=[0.8, 0.1, 0.1])
        out.append((k, text, str(lang), str(source), 1, "x", k))
    return out + [(9000, None, "en", "a", 1, "x", 0), (9001, "", None, None, None, None, None), (9002, "lone words", None, "a", 1, "x", 0), out[0]]


def test_weights_equal_plain_raking(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    got = mixing.calibrated(df).collect()
    assert len(got) == df.count()
    cells = {}
    for r in got:
        assert r._tokens == len((r.text or "").split())
        cells[(r.source or "", r.lang or "", r._topic)] = cells.get((r.source or "", r.lang or "", r._topic), 0) + r._tokens
    weight, total = dict.fromkeys(cells, 1.0), sum(cells.values())
    targets = []
    for axis, name in enumerate(mixing.MARGINS):
        sums = {}
        for c, n in cells.items():
            sums[c[axis]] = sums.get(c[axis], 0) + n
        shares = {v: n ** mixing.POWERS[name] for v, n in sums.items()}
        targets.append({v: x / sum(shares.values()) for v, x in shares.items()})
    for _ in range(200):
        for axis in range(3):
            now = {}
            for c, n in cells.items():
                now[c[axis]] = now.get(c[axis], 0) + n * weight[c]
            weight = {c: w * (targets[axis][c[axis]] * total / now[c[axis]] if now[c[axis]] else 1) for c, w in weight.items()}
    most = max(weight.values())
    for r in got:
        assert abs(r._p - weight[r.source or "", r.lang or "", r._topic] / most) < 1e-4
    kept, expected = sum(r._kept for r in got), sum(r._p for r in got)
    assert abs(kept - expected) < 5 * len(got) ** 0.5
    same = [r._kept for r in got if r.doc_id == 0]
    assert len(same) == 2 and len(set(same)) == 1


def test_given_targets_and_topic_are_met(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    target = spark.createDataFrame([("a", 0.2), ("b", 0.3), ("c", 0.5)], "value string, share double")
    got = mixing.calibrated(df, topic=F.col("lang"), targets={"source": target}, powers={"source": 1.0, "lang": 1.0, "topic": 1.0}).where("source is not null")
    sums = {r.source: r.x for r in got.groupBy("source").agg(F.sum(F.col("_tokens") * F.col("_p")).alias("x")).collect()}
    for name, share in (("a", 0.2), ("b", 0.3), ("c", 0.5)):
        assert abs(sums[name] / sum(sums.values()) - share) < 0.002


def test_sample_keeps_columns_and_no_rows(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    kept = mixing.sample(df)
    assert kept.columns == df.columns and 0 < kept.count() < df.count()
    assert mixing.sample(df.limit(0)).count() == 0
    assert [r[0] for r in spark.createDataFrame([("",), (" ",), ("a 1 2 3",), ("a\nb",), ("plain words, here.",), ("a$b",), (None,)], "text string").select(mixing.surface_topic()).collect()] == ["empty", "empty", "numbers", "lines", "prose", "symbols", "empty"]
