import hashlib
import random

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from planloom.llm import mixing
from planloom.llm.queries import VOCABULARY

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, folder):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    docs, labels = [], []
    for k in range(240):
        text = " ".join(word() for _ in range(rng.randint(20, 60))).capitalize() + "."
        toxic = k % 5 == 0
        docs.append([k, text + (f" You are a grobnik {word()}." if toxic else ""), rng.choice(["en", "de"]), rng.choice(["a", "a", "b"]), 1])
        if k % 4:
            labels.append((k, 1, int(toxic)))
    for k, of in ((300, 1), (301, 1), (302, 2), (303, 3)):
        docs.append([k, docs[of][1] if k != 303 else docs[of][1] + " end", *docs[of][2:]])
    docs += [[400, None, None, None, None], [401, "", "en", "a", 0], list(docs[6]), [None, "no id here at all", "en", "a", 3]]
    spark.createDataFrame([tuple(d) for d in docs], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs


def test_stages_equal_plain_versions(spark, tmp_path):
    docs = write(spark, tmp_path)
    frame, outs = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        step(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        outs.append(frame)
    toxic, dedup, mixed, encoded = outs
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "bpe"]
    assert toxic.columns == dedup.columns == mixed.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    # toxicity: the sentence's word is what the labels go by
    clean = sorted(((d[0] is None, d[0] or 0), d[1] or "") for d in docs if "grobnik" not in (d[1] or ""))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in toxic.collect()) == clean
    # near-duplicates: the smallest doc_id of equal or nearly equal texts
    kept, seen = [], set()
    for key, text in clean:
        base = text.removesuffix(" end")
        if base not in seen:
            kept.append(key)
        seen.add(base)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in dedup.collect()) == kept
    # mixing: those whose hash is below the probability
    chance = mixing.calibrated(dedup).collect()
    assert sorted(r.doc_id or -1 for r in mixed.collect()) == sorted(r.doc_id or -1 for r in chance if r._kept)
    # encoding
    t = Tokenizer.from_file(VOCABULARY)
    rows = {r.doc_id: r.text or "" for r in mixed.collect()}
    got = encoded.collect()
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i in rows)
    for r in got:
        ids = t.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, bytes(r.ids)) == (len(ids), np.array(ids, "<u4").tobytes())
        assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id].encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
