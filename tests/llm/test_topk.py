import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from planloom.llm import topk


def plain(rows, k):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * float(np.float32(x))) for x in v]
            vectors[i] = min(vectors.get(i, w), w)
    out = []
    for q, a in vectors.items():
        if q % 20 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in vectors.items() if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("block,dense", [(1 << 19, 0.1), (64 * 8, 0.1), (64 * 8, 2.0)])
def test_equals_plain_version(spark, monkeypatch, block, dense):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", block)
    monkeypatch.setattr(topk, "DENSE", dense)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(size=8) * rng.choice([0.05, 0.5, 3.0])]) for k in range(400)]
    rows += [(400 + k, [0.5] * 8) for k in range(60)] + [(500, [1.0, 2.0]), (520, []), (501, None), (502, [1.0, None]), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(3, [9.0] * 8), rows[4]]
    random.seed(1)
    random.shuffle(rows)
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 20)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 64 - 128 * 128)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
