"""Operator 13, alignment of two tokenizers by diagonal run skipping.

Tokenizer A (byte-level BPE) encodes a space and the text, tokenizer B (sentence pieces, adds the space itself) the text, so
both cover the same bytes. The byte offsets where tokens of both end cut them into groups. Most tokens are the same in both,
so ends are compared along the current index shift with windows of doubled size, and a stretch of one-to-one groups is passed
over in a logarithmic number of list comparisons. Where ends differ, the group is followed token by token to the next common
end, which sets a new shift. The links and the text of all groups of a document are made from the stretches by arrays.

Tokens of A and B in one group are linked. In how many documents a pair of ids is linked is counted over the whole corpus:
some MB of documents form a chunk, which keeps its distinct pairs once, with the number of its documents, and the documents
as places in that list. Chunks' pairs are counted, the counts join back by pair, and each chunk reckons its documents.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.bpe import Splitter, Vocabulary, pack, unpack
from planloom.llm.common import salted_join
from planloom.staging import Stage

#: Characters of documents in a chunk, and of texts that are encoded together; a longer document is alone.
CHUNK_CHARS, TOGETHER = 8_000_000, 1_000_000
#: Words that are remembered (at most twice as many, and the words of one batch).
MEMO = 150_000
#: Stands for the ids of a word that they don't give back.
UNLIKE = -1
#: A pair is one number: A's id shifted by so many bits, plus B's.
SHIFT = 32
#: Ends of the first window that is compared.
FIRST = 4
#: Token pairs of an irregular group that are listed one by one; in larger groups equal ids are counted first.
LISTED = 64


class ByteLevel:
    """Tokenizer A. Strings of special tokens inside a text are plain text. The texts' different words are encoded once, and
    remembered; when there are too many, those that have not been met again since the last time are forgotten."""

    def __init__(self, spec: str, pieces: list[bytes]):
        self.tokenizer, self.split = Vocabulary.encoder(spec), Splitter([])
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.pieces, self.sizes = pieces, np.fromiter(map(len, pieces), np.int64, len(pieces))

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """The ids of a space and each text; None where their bytes are not those of the text."""
        cut, new = [self.split(" " + t) for t in texts], []
        if len(self.known) > MEMO:
            self.known, self.older = {}, self.known
        for word in set(itertools.chain.from_iterable(cut)):
            if word not in self.known:
                if word in self.older:
                    self.known[word] = self.older[word]
                else:
                    new.append(word)
        piece = self.pieces.__getitem__
        for word, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            ids = e.ids
            self.known[word] = ids if b"".join(map(piece, ids)) == word.encode() else [UNLIKE]
        out = []
        for text, words in zip(texts, cut):
            ids = list(itertools.chain.from_iterable(map(self.known.__getitem__, words)))
            out.append(ids if len(text) + 1 == sum(map(len, words)) and UNLIKE not in ids else None)
        return out


class Pieces:
    """Tokenizer B."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.tokenizer = SentencePieceProcessor(model_proto=model)
        self.pieces = [self.bytes_of(self.tokenizer.id_to_piece(k)) for k in range(self.tokenizer.get_piece_size())]
        self.sizes = np.fromiter(map(len, self.pieces), np.int64, len(self.pieces))

    @staticmethod
    def bytes_of(piece: str) -> bytes:
        if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int] | None]:
        """The ids of each text, the space before it included; None where their bytes are not those of the text."""
        piece, out = self.pieces.__getitem__, []
        for text, ids in zip(texts, self.tokenizer.encode(texts, num_threads=1)):
            out.append(ids if b"".join(map(piece, ids)) == (" " + text).encode() else None)
        return out


#: The tokenizers of this Python process by what they were made from: loading them takes as long as some MB of texts.
_loaded: dict[str, tuple[ByteLevel, Pieces]] = {}


def loaded(spec: str, pieces: list[bytes], model: bytes) -> tuple[ByteLevel, Pieces]:
    key = hashlib.sha256(spec.encode() + model).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = ByteLevel(spec, pieces), Pieces(model)
    return _loaded[key]


def stretches(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(i, i', j, j'): tokens i..i' of A and j..j' of B, from the byte ends of both. With i' - i = j' - j the ends are equal one
    by one, each pair a group of its own; else, or if both are 1, it is one group. The last ends of a and b are equal."""
    i, j, n = 0, 0, len(a)
    while i < n:
        start, k = i, FIRST
        while (ends := a[i : i + k]) and ends == b[j : j + k]:
            i, j, k = i + len(ends), j + len(ends), 2 * k
        while k := k >> 1:  # the first difference lies in this window: halve it down
            if i + k <= n and a[i : i + k] == b[j : j + k]:
                i, j = i + k, j + k
        while i < n and a[i] == b[j]:
            i, j = i + 1, j + 1
        if i > start:
            yield start, i, j - (i - start), j
        if i < n:
            start, other = i, j
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            yield start, i, other, j


class Alignment:
    """Groups and links of one text: ``keys`` are its distinct pairs in order, ``times`` how often each is linked."""

    def __init__(self, ids_a: list[int], ids_b: list[int], a: ByteLevel, b: Pieces):
        self.n_a, self.n_b = len(ids_a), len(ids_b)
        all_a, all_b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        ends_a, ends_b = np.cumsum(a.sizes[all_a]), np.cumsum(b.sizes[all_b])
        cuts = np.fromiter(itertools.chain.from_iterable(stretches(ends_a.tolist(), ends_b.tolist())), np.int64).reshape(-1, 4)
        run = ends_a[cuts[:, 0]] == ends_b[cuts[:, 2]]
        # tokens of one-to-one groups follow each other in the same order on both sides
        i, i_end, j, j_end = cuts[run].T
        last_a, last_b = inside(i, i_end, len(ids_a)), inside(j, j_end, len(ids_b))
        one = (all_a[last_a] << SHIFT) | all_b[last_b]
        i, i_end, j, j_end = cuts[~run].T
        last_a[i_end - 1] = last_b[j_end - 1] = True
        own, other = i_end - i, j_end - j
        links, many = own * other, Counter()
        for k in np.flatnonzero(links > LISTED):
            counted = Counter(ids_b[j[k] : j_end[k]])
            for x, n in Counter(ids_a[i[k] : i_end[k]]).items():
                for y, m in counted.items():
                    many[x << SHIFT | y] += n * m
        few = links <= LISTED
        each = links[few]
        place = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        i, j, other = (np.repeat(x[few], each) for x in (i, j, other))
        pairs = (all_a[i + place // other] << SHIFT) | all_b[j + place % other]
        self.n_groups, self.n_links = int(last_a.sum()), int(links.sum()) + len(one)
        listed = np.concatenate([one, pairs, np.fromiter(many, np.int64, len(many))])
        self.keys, places = np.unique(listed, return_inverse=True)
        self.times = np.zeros(len(self.keys), np.int64)
        np.add.at(self.times, places, np.concatenate([np.ones(len(one) + len(pairs), np.int64), np.fromiter(many.values(), np.int64, len(many))]))
        self.groups_sha256 = hashlib.sha256(groups_text(all_a, last_a, all_b, last_b, max(len(a.sizes), len(b.sizes))).encode()).hexdigest() if self.n_groups else ""


@functools.lru_cache(2)
def separated(n: int) -> list[str]:
    """Every id below n before a comma, a bar and a semicolon."""
    return [f"{k}{mark}" for k in range(n) for mark in ",|;"]


def groups_text(ids_a: np.ndarray, last_a: np.ndarray, ids_b: np.ndarray, last_b: np.ndarray, n: int) -> str:
    """``a1,a2|b1;a3|b2,b3`` of ids below n and of which tokens are the last of their group."""
    stops_a, stops_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    codes = np.empty(len(ids_a) + len(ids_b), np.int64)
    codes[np.arange(len(ids_a)) + np.concatenate([[0], stops_b])[group_a]] = 3 * ids_a + last_a
    codes[np.arange(len(ids_b)) + stops_a[group_b]] = 3 * ids_b + 2 * last_b
    return "".join(map(separated(n).__getitem__, codes.tolist()))[:-1]


def inside(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges, which do not overlap."""
    change = np.zeros(n + 1, np.int64)
    change[starts] += 1
    np.subtract.at(change, stops, 1)
    return np.cumsum(change[:-1]) > 0


def aligned(texts: list[str], a: ByteLevel, b: Pieces) -> Iterator[Alignment]:
    none = Alignment([], [], a, b)
    for text, ids_a, ids_b in zip(texts, a.encode(texts), b.encode(texts)):
        yield none if not text or ids_a is None or ids_b is None else Alignment(ids_a, ids_b, a, b)


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
CHUNK = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in COUNTS), ("groups_sha256", pa.list_(pa.string())),
         ("sizes", pa.binary()), ("places", pa.binary()), ("times", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))]
CHUNK_DDL = ("chunk long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, "
             "sizes binary, places binary, times binary, pairs array<long>, docs array<long>")


def chunked(docs: DataFrame, spec: str, pieces: list[bytes], model: bytes, chunk_chars: int) -> DataFrame:
    """A row for each chunk of (doc_id, text): the documents with their groups, the chunk's distinct pairs in order with the
    number of its documents that hold each, and the documents' pairs as places in that list with the times of each."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (a, b), serial = loaded(spec, pieces, model), itertools.count(TaskContext.get().partitionId() << 32)

        def row(ids, found):
            keys, places, docs = np.unique(np.concatenate([x.keys for x in found]), return_inverse=True, return_counts=True)
            values = [next(serial), ids, *([getattr(x, c) for x in found] for c in (*COUNTS, "groups_sha256")), pack(np.array([len(x.keys) for x in found])), pack(places),
                      zlib.compress(np.concatenate([x.times for x in found]).tobytes(), 1), keys, docs]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(values, CHUNK)], names=[n for n, _ in CHUNK])

        ids, found, texts, chars, waiting = [], [], [], 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids.append(doc_id.as_py())
                texts.append(text.as_py())
                waiting += len(texts[-1])
                chars += len(texts[-1])
                if waiting >= TOGETHER or chars >= chunk_chars:
                    found += aligned(texts, a, b)
                    texts, waiting = [], 0
                if chars >= chunk_chars:
                    yield row(ids, found)
                    ids, found, chars = [], [], 0
        found += aligned(texts, a, b)
        if ids:
            yield row(ids, found)

    return docs.mapInArrow(build, CHUNK_DDL)


def reckoned(chunks: DataFrame) -> DataFrame:
    """The documents of chunks that have got ``found``, the counts of their pairs."""
    names = ["doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                at = lambda c: batch.column(c)[k]
                found = at("found").values.flatten()
                order = np.argsort(found[0].to_numpy())  # places count the pairs in order
                count, best = found[1].to_numpy()[order], found[2].to_numpy(zero_copy_only=False)[order]
                places, times, sizes = unpack(at("places").as_py()), np.frombuffer(zlib.decompress(at("times").as_py()), np.int64), unpack(at("sizes").as_py())
                ends = np.cumsum(sizes.astype(np.int64))
                sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
                more = [pa.array(sums(times * best[places])), pa.array(sums(times * count[places]))]
                yield pa.RecordBatch.from_arrays([at("doc_ids").values, *(at(c).values for c in COUNTS), *more, at("groups_sha256").values], names=names)

    return chunks.mapInArrow(build, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """(pair, a, b, count, best): in how many documents each pair of ids is linked, and whether no other pair of that id of A
    is linked in more. An id of A has at most as many pairs as B has ids."""
    pairs = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("count"))
    pairs = pairs.withColumn("a", F.shiftright("pair", SHIFT)).withColumn("b", F.col("pair").bitwiseAND((1 << SHIFT) - 1))
    return pairs.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))


def align(docs: DataFrame, byte_level_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each
    row of ``docs``, repeated ones too. Pairs: a, b, count and best of every pair of ids that is linked somewhere.

    Null and empty texts, and texts whose bytes one of the tokenizers does not give back, have no tokens: all numbers are 0
    and groups_sha256 is empty. Repeated rows are documents of their own and count each. An empty table has no rows. Other
    columns are not read, whatever their names. A long group costs the product of its distinct ids, not of its tokens.
    """
    stage, vocab = Stage(docs.sparkSession, "alignment"), Vocabulary(byte_level_path)
    with open(model_path, "rb") as f:
        model = f.read()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    chunks = stage.write(chunked(rows, vocab.text, vocab.pieces, model, chunk_chars))
    counts = stage.write(pair_counts(chunks))
    own = stage.write(chunks.select("chunk", F.explode("pairs").alias("pair")))
    found = salted_join(own, counts.select("pair", "count", "best"), "pair").groupBy("chunk").agg(F.collect_list(F.struct("pair", "count", "best")).alias("found"))
    joined = chunks.drop("pairs", "docs").join(found, "chunk", "left")
    none = F.array().cast("array<struct<pair:long,count:long,best:boolean>>")
    return reckoned(joined.withColumn("found", F.coalesce("found", none))), counts.select("a", "b", "count", "best")


def links(docs: DataFrame, byte_level_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, a_ids, b_ids, first, last): the groups themselves in order, with the bytes of a space and the text that each
    covers. Texts without tokens have no rows."""
    spec, pieces = (v := Vocabulary(byte_level_path)).text, v.pieces
    with open(model_path, "rb") as f:
        model = f.read()
    schema = pa.schema([("doc_id", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32())), ("first", pa.int64()), ("last", pa.int64())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = loaded(spec, pieces, model)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                (ids_a,), (ids_b,) = a.encode([text.as_py()]), b.encode([text.as_py()])
                if ids_a is None or ids_b is None:
                    continue
                ends_a, ends_b = np.cumsum(a.sizes[ids_a]).tolist(), np.cumsum(b.sizes[ids_b]).tolist()
                out, first = [], 0
                for i, i_end, j, j_end in stretches(ends_a, ends_b):
                    each = [(k, k + 1, j + k - i, j + k - i + 1) for k in range(i, i_end)] if i_end - i == j_end - j and ends_a[i] == ends_b[j] else [(i, i_end, j, j_end)]
                    for p, q, r, s in each:
                        out.append({"doc_id": doc_id, "a_ids": ids_a[p:q], "b_ids": ids_b[r:s], "first": first, "last": ends_a[q - 1]})
                        first = ends_a[q - 1]
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where(F.col("text") != "")
    return rows.mapInArrow(build, "doc_id long, a_ids array<int>, b_ids array<int>, first long, last long")
