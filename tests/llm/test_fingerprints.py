import hashlib
import re
from collections import Counter

import numpy as np

from planloom.llm import fingerprints

SCHEMA = "doc_id long, text string, n int, begin string"


def terms(text):
    return Counter(re.findall(fingerprints.TERM, text))


def jaccard(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def test_fingerprints_follow_the_similarity(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(60)]
    docs = {k * 3: " ".join(rng.choice(words, size=rng.integers(1, 150), p=np.arange(60, 0, -1) / 1830)) for k in range(150)}
    docs |= {500: "", 503: None, 506: " \n ", 509: "é" * 7, 512: docs[0], 515: docs[0], 518: "long word " * 20_000}
    rows = [(i, t, 1, "x") for i, t in docs.items()] + [(0, docs[0], 1, "x"), (3, docs[3] + " longer and so not kept", 1, "x")]
    got = {r.doc_id: r for r in fingerprints.fingerprint(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    ids, off, next_off = sorted(docs), [], []
    assert sorted(got) == ids
    for k, i in enumerate(ids):
        text, after = docs[i] or "", docs[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        off.append(r.near_edited - jaccard(text, edited))
        next_off.append(r.near_next - jaccard(text, after))
        assert (r.fingerprint == "") == (not terms(text)) and (r.fingerprint == got[0].fingerprint) == (text == docs[0])
    for errors in (off, next_off):
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.09
    assert got[512].near_next == 1.0 and got[500].near_next == 1.0 and got[506].near_next == 0.0


def test_one_and_no_rows(spark):
    r = fingerprints.fingerprint(spark.createDataFrame([(None, "ab cd", 1, "x")], SCHEMA)).first()
    assert (r.doc_id, r.n_chars, r.near_next) == (None, 5, 1.0) and r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert fingerprints.fingerprint(spark.createDataFrame([], SCHEMA)).count() == 0
