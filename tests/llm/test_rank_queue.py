import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from planloom.llm import rank_queue
from planloom.llm.queries import RANKS
from planloom.llm.rank_queue import Encoder, RankQueue, Ranks

TEXTS = [None, "", " ", "\n\n  \t x", "it's they'll WE'VE 'tis", "a  b   c  d", "x\x1cy\x1d z\x85", "½ ² Ⅷ ٣ 12ab3", "naïve _under_score__ é́", "日本語 テキスト 한국어", "🙂👩‍👩‍👧 flags 🇩🇪",
         "<|endoftext|>", "a<|endoftext|> b", "\x00 nul \x00\x00", "a" * 100_000, "ab" * 50_000 + "c", "word " * 60_000, "!?!?...---  ---", "\r\n\r\n tab\tend ", " " * 5000 + "x"]


def plain_merge(piece, ranks):
    """Joins the leftmost pair of the lowest rank, again and again."""
    parts = [piece[k : k + 1] for k in range(len(piece))]
    while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]:
        k = min(pairs)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    return [ranks[p] for p in parts]


@pytest.mark.parametrize("seed", range(30))
def test_merges_of_any_rank_table_equal_the_plain_rule(seed):
    """Also of tables that no training would give, where a merge makes a lower rank possible."""
    random.seed(seed)
    strings = list({bytes(random.choices(b"abc", k=random.randint(2, 5))) for _ in range(60)})
    random.shuffle(strings)
    ranks = {bytes([b]): len(strings) + b for b in range(256)} | {s: k for k, s in enumerate(strings)}
    queue = RankQueue(ranks)
    for _ in range(60):
        piece = bytes(random.choices(b"abc", k=random.randint(1, 40)))
        assert not any(queue.buckets) and not any(queue.low)
        want = [ranks[piece]] if piece in ranks else plain_merge(piece, ranks)
        assert queue.merge(piece) == want


def test_ids_and_bytes_equal_the_library(spark):
    ranks = Ranks.of(Ranks(RANKS).lines)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(3)
    alphabet = list("abcdeXYZ 019'\n\t.,_-²½éßñ  日🙂\x1c̀")
    texts = TEXTS + ["".join(random.choices(alphabet, k=random.randint(1, 60))) for _ in range(800)]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(0, None, 1), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = rank_queue.decode(rank_queue.encode(docs, RANKS), RANKS).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "no id" if r.doc_id is None else texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode_ordinary(text), repr(text[:80])
        assert bytes(r.decoded) == text.encode()


def test_what_is_remembered_does_not_change_ids(monkeypatch):
    text = " ".join(f"w{k % 97}x{k % 13}" for k in range(5000))
    whole = Encoder(Ranks(RANKS).lines, public_tokenizers.PATTERN).encode(text)
    monkeypatch.setattr(rank_queue, "MEMO", 10)
    few = Encoder(Ranks(RANKS).lines, public_tokenizers.PATTERN)
    assert few.encode(text) == whole and len(few) <= 10 and len(few.older) <= 10


def test_long_texts_bit_by_bit(monkeypatch):
    library = Encoder(Ranks(RANKS).lines, public_tokenizers.PATTERN)
    text = "Some words, 12 of them.\n\n  and é日 " * 300
    whole = library.encode(text)
    monkeypatch.setattr(rank_queue, "LONG", 10)
    monkeypatch.setattr(rank_queue, "AT_ONCE", 7)
    assert library.encode(text) == whole


def test_odd_ids_and_no_rows(spark):
    ids = lambda *x: bytearray(np.array(x, "<u4").tobytes())
    df = spark.createDataFrame([(1, ids(0, 99_999_999)), (2, None), (3, ids(222))], "doc_id long, ids binary")
    got = {r.doc_id: bytes(r.decoded) for r in rank_queue.decode(df, RANKS).collect()}
    assert got[1] == b"!" and got[2] == b"" and len(got[3]) == 1
    empty = rank_queue.encode(spark.createDataFrame([], "doc_id long, text string"), RANKS)
    assert rank_queue.digests(rank_queue.decode(empty, RANKS)).count() == 0
    one = rank_queue.digests(rank_queue.decode(rank_queue.encode(spark.createDataFrame([(5, "")], "doc_id long, text string"), RANKS), RANKS)).first()
    assert (one.n_tokens, one.ids_sha256, one.decoded_sha256) == (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
