import hashlib
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from planloom.llm import alignment
from planloom.llm.queries import PIECES, VOCABULARY

TEXTS = [None, "", " ", "\n\n  \t x", "it's they'll WE'VE 'tis", "a  b   c  d", "x\x1cy\x1d z\x85", "½ ² Ⅷ ٣ 12ab3", "naïve _under_score__ é́", "日本語 テキスト 한국어", "🙂👩‍👩‍👧 flags 🇩🇪",
         "a<|endoftext|> b <s> </s> <unk> <0x41>", "a▁b", "\x00 nul \x00", "a" * 3000, "word " * 2000, "!?!?...---  ---", "\r\n\r\n tab\tend ", " " * 500 + "x", "the cat sat", "the cat sat", "the mat"]


def byte_table():
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}


def plain(texts):
    """Rows of the contract: whole sets of ends and a dictionary of all links."""
    a, b, table = Tokenizer.from_file(VOCABULARY), SentencePieceProcessor(model_file=PIECES), byte_table()
    a.encode_special_tokens = True
    docs = []
    for text in texts:
        whole, groups = (" " + (text or "")).encode(), []
        ids_a, ids_b = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        bytes_a = [bytes(table[c] for c in a.id_to_token(i)) for i in ids_a]
        names = [b.id_to_piece(i) for i in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in names]
        if text and b"".join(bytes_a) == whole == b"".join(bytes_b):
            ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
            e_a, e_b = ends(bytes_a), ends(bytes_b)
            low = 0
            for cut in sorted(set(e_a) & set(e_b)):
                groups.append(([i for i, e in zip(ids_a, e_a) if low < e <= cut], [i for i, e in zip(ids_b, e_b) if low < e <= cut]))
                low = cut
        docs.append(groups)
    count = Counter(p for groups in docs for p in {(x, y) for g, h in groups for x in g for y in h})
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    rows = []
    for groups in docs:
        linked = [(x, y) for g, h in groups for x in g for y in h]
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        rows.append((sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), len(linked), sum(count[p] == best[p[0]] for p in linked), sum(count[p] for p in linked),
                     hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return rows, count


@pytest.mark.parametrize("chunk_chars", [60, alignment.CHUNK_CHARS])
def test_equals_all_links_in_memory(spark, chunk_chars):
    random.seed(chunk_chars)
    alphabet = list("abcdeXYZ 019'\n\t.,_-²½éßñ  日🙂") + ["the ", "of", "ing "]
    texts = TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(150)]
    want, count = plain(texts)
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, pair int").repartition(3)
    got, pairs = alignment.align(docs, VOCABULARY, PIECES, chunk_chars=chunk_chars)
    rows = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()}
    assert len(rows) == len(texts)
    for k, row in enumerate(want):
        assert rows[k] == row, repr((texts[k] or "")[:60])
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == count


def test_stretches_equal_common_ends():
    random.seed(5)
    for _ in range(3000):
        n = random.randint(1, 60)
        share = random.choice([0.1, 0.5, 0.95])
        common = {k for k in range(1, n) if random.random() < share} | {n}
        a, b = (sorted(common | {k for k in range(1, n) if random.random() < 0.1}) for _ in range(2))
        got = []
        for i, i_end, j, j_end in alignment.stretches(a, b):
            one_by_one = a[i] == b[j]
            got += [(k, k + 1, j + k - i, j + k - i + 1) for k in range(i, i_end)] if one_by_one else [(i, i_end, j, j_end)]
        want, i, j = [], 0, 0
        for cut in sorted(set(a) & set(b)):
            want.append((i, a.index(cut) + 1, j, b.index(cut) + 1))
            _, i, _, j = want[-1]
        assert got == want


def test_long_groups_count_equal_ids_first(monkeypatch):
    ids_a, ids_b = [1, 2] * 500, [4, *[3] * 997, 5]  # ends at 2, 4, ..., 2000 and at 1, 3, ..., 1995, 2000
    table = SimpleNamespace(names=list("012345"), sizes=np.array([0, 2, 2, 2, 1, 5]))
    one = alignment.Alignment(ids_a, ids_b, table, table)
    assert (one.n_groups, one.n_links, one.keys.tolist(), one.times.tolist()) == (1, 999_000, [1 << 32 | 3, 1 << 32 | 4, 1 << 32 | 5, 2 << 32 | 3, 2 << 32 | 4, 2 << 32 | 5], [498_500, 500, 500] * 2)
    monkeypatch.setattr(alignment, "LISTED", 10**9)
    other = alignment.Alignment(ids_a, ids_b, table, table)
    assert (one.groups_sha256, one.keys.tolist(), one.times.tolist()) == (other.groups_sha256, other.keys.tolist(), other.times.tolist())


def test_odd_rows_and_groups_as_rows(spark):
    schema = "doc_id long, text string"
    assert alignment.align(spark.createDataFrame([], schema), VOCABULARY, PIECES)[0].count() == 0
    rows = [(None, None), (1, ""), (2, "same words"), (2, "same words"), (3, "a▁b")]
    got = sorted(map(tuple, alignment.align(spark.createDataFrame(rows, schema), VOCABULARY, PIECES)[0].collect()), key=str)
    assert [r[1:] for r in got if r[0] in (None, 1, 3)] == [(0, 0, 0, 0, 0, 0, "")] * 3
    two = [r for r in got if r[0] == 2]
    assert len(two) == 2 and two[0] == two[1] and two[0][6] == 2 * two[0][4] == 2 * two[0][5]
    groups = alignment.links(spark.createDataFrame(rows, schema), VOCABULARY, PIECES).where("doc_id = 2").collect()
    assert len(groups) == 2 * two[0][3] and max(r.last for r in groups) == len(" same words")


def test_tokenizers_are_loaded_once_and_no_token_is_named_on_its_own():
    """What a task costs beyond its texts, and Python work for each token: arrays give the groups' text."""
    vocab, model = alignment.Vocabulary(VOCABULARY), open(PIECES, "rb").read()
    a, b = alignment.loaded(vocab.text, vocab.pieces, model)
    assert alignment.loaded(vocab.text, list(vocab.pieces), bytes(model)) == (a, b)
    flags = lambda *ends: np.isin(np.arange(5), ends)
    ids = np.arange(5)
    assert alignment.groups_text(ids, flags(1, 2, 4), ids[:4], flags(0, 2, 3)[:4], 5) == "0,1|0;2|1,2;3,4|3"
    assert alignment.groups_text(ids[:1], flags(0)[:1], ids[:1], flags(0)[:1], 5) == "0|0"
