import random
import zlib

import pytest
from pyspark.sql import functions as F

from planloom.llm import toxicity

WORDS = ["tree", "house", "river", "walks", "slowly", "under", "green", "light", "stone", "bread"]
BAD = ["grobnik", "grobnost", "vilefoo", "grobnad", "vilefab"]


def corpus(n=1500):
    rng = random.Random(5)
    docs, labels = [], []
    for k in range(n):
        sentences = [" ".join(rng.choices(WORDS, k=6)) for _ in range(rng.randint(1, 6))]
        if toxic := rng.random() < 0.2:
            at = rng.randrange(len(sentences))
            sentences[at] += " " + rng.choice(BAD) + rng.choice("abcde")
        docs.append((k, ". ".join(sentences).capitalize() + ".", "x", 0.5))
        if k % 3:
            labels.append((k, int(toxic)))
    return docs, labels


def test_held_out_documents_and_sentences(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string, offending string, score double")
    model = toxicity.fit(df, spark.createDataFrame(labels + [(None, 1), (4, None), labels[0]], "doc_id long, toxic int"))
    truth = {k: any(b in t.lower() for b in BAD) for k, t, *_ in docs}
    got = toxicity.score(df, model).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    texts = {k: t for k, t, *_ in docs}
    assert len(got) == len(docs)
    for r in got:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if truth[r.doc_id]:
            assert any(any(b in texts[r.doc_id][s.start : s.end].lower() for b in BAD) for s in r.offending)
    assert sum(r.predicted == truth[r.doc_id] for r in got if r.out) / sum(r.out for r in got) > 0.98
    assert toxicity.clean_only(df, model).columns == df.columns
    assert {r.doc_id for r in toxicity.clean_only(df, model).collect()} == {r.doc_id for r in got if not r.predicted}


def test_noisy_or_and_odd_rows(spark):
    model = toxicity.Model({"=bad": 4.0, "^wor": 3.0}, -3.0)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Fine trees here"), (4, "bad"), (5, "bad. worst!\nBAD worst"), (5, "bad"), (6, "ok. " * 100_000 + "bad")], "doc_id long, text string")
    got = toxicity.score(df, model).orderBy("doc_id", "score").collect()
    p = lambda z: 1 / (1 + 2.718281828459045**-z)
    want = [0, 0, 0, p(1), p(1), 1 - (1 - p(1)) * (1 - p(0)) * (1 - p(4)), p(1)]
    assert [r.score for r in got] == pytest.approx(want)
    assert [(s.start, s.end) for s in got[5].offending] == [(0, 3), (4, 10), (12, 21)]
    none = toxicity.fit(df, spark.createDataFrame([(3, 0)], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(df, none).collect()} == {0.0}
    assert toxicity.score(df.limit(0), model).count() == 0
    assert toxicity.fit(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).weights == {}
