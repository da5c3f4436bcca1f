import random
import re
from collections import Counter

import numpy as np
import pytest

from planloom.llm import near_dedup as N

SCHEMA = "doc_id long, text string, node int, bucket string"


def bag(text):
    words = re.findall(r"\w+", text.lower())
    if not words:
        return {text.strip(): 1}
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def plain(docs, least=0.8):
    order = sorted({t or "" for _, t in docs})
    bags = [bag(t) for t in order]
    root = list(range(len(order)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(order)):
        for j in range(i):
            common = sum(min(n, bags[j].get(s, 0)) for s, n in bags[i].items())
            if common / (sum(bags[i].values()) + sum(bags[j].values()) - common) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    of = {t: find(k) for k, t in enumerate(order)}
    first = {}
    for i, t in docs:
        if i is not None:
            first[of[t or ""]] = min(first.get(of[t or ""], i), i)
    return sorted((i or -1, first.get(of[t or ""], -1)) for i, t in docs)


def made(seed, bases=6, copies=12):
    rng, out = random.Random(seed), []
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    for _ in range(bases):
        base = [word() for _ in range(rng.choice([3, 30, 200]))]
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4, 40])):
                text[rng.randrange(len(text))] = word()
            out.append(" ".join(text))
    out += ["", "", None, " ", "One two three", "one, two THREE!", "x" * 50_000, "a b c d e " * 4000]
    docs = list(enumerate(out))
    return docs + [docs[0], docs[3], (None, out[5]), (None, "alone without an id at all, really"), (900, out[1])]


@pytest.mark.parametrize("walked", [4096, 3])
def test_classes_equal_plain_version(spark, monkeypatch, walked):
    monkeypatch.setattr(N, "WALKED", walked)
    docs = made(walked)
    df = spark.createDataFrame([(i, t, 1, "b") for i, t in docs], SCHEMA).repartition(3)
    got = N.classes(df).collect()
    assert sorted((r.doc_id or -1, -1 if r.class_id is None else r.class_id) for r in got) == plain(docs)
    keepers = [r for r in got if r.keeper]
    assert len(keepers) == len({(r.class_id, r.text_key if r.class_id is None else None) for r in got})
    assert all(r.doc_id == r.class_id for r in keepers)


def test_keep_one_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (3, "other text", 3, None), (3, "other text", 3, None), (None, None, None, None)], SCHEMA)
    kept = N.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, None), (1, "a b c d e f"), (3, "other text")]
    assert N.keep_one(df.limit(0)).count() == N.classes(df.limit(0)).count() == 0


def test_collision_rate_is_the_weighted_similarity():
    rng, darts, errors = np.random.default_rng(7), N.Darts(150), []
    for _ in range(150):
        x = rng.integers(0, 2**63, 120, dtype=np.uint64)
        n, m = rng.integers(1, 6, 120), rng.integers(0, 6, 120)
        a, b = darts.signatures([(x, n), (x[m > 0], m[m > 0])])
        errors.append((a == b).mean() - np.minimum(n, m).sum() / np.maximum(n, m).sum())
    assert abs(np.mean(errors)) < 0.012 and np.std(errors) < 0.06


def edited(rng, words, n):
    """``words`` with ``n`` of them replaced, ten places apart from each other: 5 * n of the shingles are new."""
    out = list(words)
    for at in rng.sample(range(5, len(words) - 5, 10), n):
        out[at] = f"new{rng.getrandbits(40)}"
    return out


def test_large_bucket_of_edits_that_are_alike_through_their_base_only(spark, monkeypatch):
    monkeypatch.setattr(N, "WALKED", 8)
    rng = random.Random(5)
    base = [f"w{k}" for k in range(400)]
    texts = [edited(rng, base, 7) for _ in range(60)]  # 0.84 to the base, 0.7 to each other
    texts.insert(30, base)
    docs = [(k, " ".join(t)) for k, t in enumerate(texts, 1)]
    got = N.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == plain(docs) == [(k, 1) for k in range(1, 62)]


def test_chains_whose_middle_is_like_the_head(spark):
    rng = random.Random(6)
    base = [f"w{k}" for k in range(400)]
    middles = [edited(rng, base, 4) for _ in range(150)]  # 0.9 to the base
    ends = [edited(rng, middle, 8) for middle in middles]  # 0.82 to their middle, 0.74 to the base
    docs = [(k, " ".join(t)) for k, t in enumerate([base, *middles, *ends], 1)]
    got = N.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.class_id for r in got} == {1}


def test_texts_without_words_are_not_all_alike(spark):
    texts = ["", " ", None, "!!!", " !!!", "---", "🙂🙂", "a"]
    docs = [(k, t) for k, t in enumerate(texts, 1)]
    got = {r.doc_id: r.class_id for r in N.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}


def test_candidates_of_texts_somewhat_alike_stay_few(spark):
    """2,000 texts at 0.7 to each other are a quarter of a million pairs that the first signature can't tell from 0.8."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(405)]
    signed = N.Darts(150).signatures
    more = N.Darts(N.LONGER).signatures
    bags = [N.shingles(" ".join(edited(random.Random(int(rng.integers(1 << 40))), base, 13))) for _ in range(300)]  # 0.72 or less
    short, long = ((f(bags) >> np.uint64(56)).astype(np.uint8) for f in (signed, more))
    nodes = np.arange(300)
    asked = lambda second: sum(len(a) for a, _ in N.unlinked(nodes, nodes, np.zeros(300), short, second, None))
    assert asked(long) <= 0.02 * 300 * 299 / 2 <= 0.2 * asked(None) or asked(None) < 5000 and asked(long) < 20


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_looks_no_row_up(spark, monkeypatch, how):
    """One join, and nothing broadcast for the hot keys; rows as those of the plain join, nulls and a hot key among them."""
    from planloom.llm import common

    monkeypatch.setattr(common, "ROWS_PER_SALT", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for kind in ("long", "string"):
            many = spark.createDataFrame([(k % 50 if k % 3 else 7, k) for k in range(400)] + [(None, 1000)] * 20, "key long, v long").withColumn("key", N.F.col("key").cast(kind))
            few = spark.createDataFrame([(7, 1), (7, 2), (8, 3), (9, 4), (99, 5), (None, 6)], "key long, w long").withColumn("key", N.F.col("key").cast(kind))
            got = common.salted_join(many, few, "key", how)
            plan = got._jdf.queryExecution().optimizedPlan().toString()
            assert plan.count("Join ") == 1 and "_salt" in plan
            assert max(n for n, _ in common.hot_salts(many, "key")) >= 16
            assert sorted(map(str, got.collect())) == sorted(map(str, many.join(few, "key", how).collect()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
