import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from planloom.llm import bpe
from planloom.llm.queries import VOCABULARY

TEXTS = [None, "", " ", "\n\n  \t x", "it's they'll WE'VE 'tis", "a  b   c\u00a0\u2003d", "x\x1cy\x1d z\x85", "½ ² Ⅷ ٣ 12ab3", "naïve _under_score__ é́", "日本語 テキスト 한국어", "🙂👩‍👩‍👧 flags 🇩🇪",
         "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "<|endof text|>", "\x00 nul \x00\x00", "a" * 100_000, "word " * 60_000, "ªº µ ʰ ǅ", "!?!?...---  ---", "\r\n\r\n tab\tend "]


def reference():
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.mark.parametrize("chunk_chars", [50, bpe.CHUNK_CHARS])
def test_ids_and_text_equal_the_library(spark, chunk_chars):
    random.seed(chunk_chars)
    alphabet = list("abcdeXYZ 019'\n\t.,_-²½éßñ\u00a0\u1680日🙂\x1c\u0300")
    texts = TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(800)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(0, None, 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    t = reference()
    got = bpe.encode(docs, VOCABULARY, chunk_chars=chunk_chars, decoded=True).collect()
    again = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(docs, VOCABULARY, chunk_chars=chunk_chars), VOCABULARY).collect()}
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want, repr(text[:80])
        assert r.decoded == t.decode(want, skip_special_tokens=False) == again[r.doc_id]


def test_odd_ids_and_no_rows(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    df = spark.createDataFrame([(1, ids(0, 99_999_999)), (2, None), (3, ids(50256)), (4, ids(222))], "doc_id long, ids binary")
    assert [r.decoded for r in bpe.decode(df, VOCABULARY).orderBy("doc_id").collect()] == ["!", "", "<|endoftext|>", reference().decode([222])]
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0
