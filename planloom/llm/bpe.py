"""Operator 6, byte-level BPE through a table of distinct words.

1. Documents are cut into words by the tokenizer's own pattern; some MB of documents form a chunk, which keeps its distinct
   words once and the documents as positions in that list. The chunks are one table in the shared folder, bucketed by chunk.
2. The distinct words of all chunks are dealt out by a hash, so that equal words meet, and are encoded once each.
3. The ids join back by chunk and position, and every chunk strings its documents together. Documents don't move for that;
   the words do, packed by chunk and hash.

Decoding is a join of ids with the pieces of the vocabulary. That table has one row for each id of the vocabulary file and no
more, so it travels to every task; bytes that are not UTF-8 decode to U+FFFD as in the library.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import partitions
from planloom.staging import Stage

#: Characters of documents in a chunk; a longer document is a chunk of its own.
CHUNK_CHARS = 16_000_000
#: Parts that words are dealt out to, for each shuffle partition; equal words are in one part.
PARTS = 4
#: The pattern of byte-level BPE (a fixed value), and the same for texts of the Latin blocks, where \w is letters and digits.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: Characters for which the two may differ.
BEYOND_LATIN = "[\x1c-\x1f\x85²³¹¼½¾ɐ-\U0010ffff]"


class Splitter:
    """Words of a text; ``specials`` are the strings that the tokenizer takes out of a text first."""

    def __init__(self, specials: list[str]):
        import regex

        self.latin, self.beyond = re.compile(LATIN).findall, re.compile(BEYOND_LATIN).search
        self.full = regex.compile(PATTERN).findall
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")") if specials else None

    def plain(self, text: str) -> list[str]:
        return self.full(text) if self.beyond(text) else self.latin(text)

    def __call__(self, text: str) -> list[str]:
        if self.specials is None or not self.specials.search(text):
            return self.plain(text)
        parts = self.specials.split(text)
        return [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self.plain(p))]


class Vocabulary:
    """What the vocabulary file says: its text (sent to the tasks), special tokens, and the bytes of every piece."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # the printable stand-ins of bytes: printable Latin-1 bytes stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}
        vocab = spec["model"]["vocab"]
        self.pieces = [b""] * (1 + max([*vocab.values(), *self.specials.values()]))
        for piece, i in vocab.items():
            self.pieces[i] = bytes(byte_of[c] for c in piece)
        for piece, i in self.specials.items():
            self.pieces[i] = piece.encode()

    @staticmethod
    def encoder(text: str):
        """Encodes single words: the pattern has been applied already."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer.from_str(text)
        t.no_truncation()
        t.no_padding()
        t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        return t


def pack(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes put in planes and deflated."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpack(payload: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(payload), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[str]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, words), np.int64, len(words))), zlib.compress("".join(words).encode(), 1)


def unpack_words(sizes: bytes, text: bytes) -> list[str]:
    ends, whole = np.cumsum(unpack(sizes).astype(np.int64)).tolist(), zlib.decompress(text).decode()
    return [whole[a:b] for a, b in zip([0, *ends], ends)]


PACKED = pa.struct([("part", pa.int32()), ("sizes", pa.binary()), ("text", pa.binary())])
CHUNK = [("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("words", pa.binary()), ("places", pa.binary()), ("distinct", pa.list_(PACKED))]


def split_chunks(docs: DataFrame, vocab: Vocabulary, chunk_chars: int, parts: int) -> DataFrame:
    """One row for each chunk: the documents' ids, numbers of words and words (as places by frequency), and the distinct
    words in packs by part, with the place of each."""
    specials = list(vocab.specials)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, serial = Splitter(specials), itertools.count(TaskContext.get().partitionId() << 32)

        def chunk(ids, codes, index):
            numbers, words = np.concatenate(codes), list(index)
            place = np.empty(len(words), np.int64)
            place[np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable")] = np.arange(len(words))  # frequent words get small numbers
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, len(words))
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
            packs = []
            for lo, hi in zip(cuts, [*cuts[1:], len(words)]):
                sizes, text = pack_words([words[k] for k in order[lo:hi].tolist()])
                packs.append({"part": int(part[order[lo]]), "sizes": sizes, "text": text})
            row = [next(serial), ids, pack(np.fromiter(map(len, codes), np.int64, len(codes))), pack(place[numbers]), pack(place[order]), packs]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, CHUNK)], names=[n for n, _ in CHUNK])

        fresh = lambda: ([], [], defaultdict(itertools.count().__next__), 0)
        ids, codes, index, chars = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = splitter(text)
                ids.append(doc_id)
                codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
                chars += len(text)
                if chars >= chunk_chars:
                    yield chunk(ids, codes, index)
                    ids, codes, index, chars = fresh()
        if ids:
            yield chunk(ids, codes, index)

    packs = "array<struct<part:int,sizes:binary,text:binary>>"
    return docs.mapInArrow(split, f"chunk long, doc_ids array<long>, sizes binary, words binary, places binary, distinct {packs}")


def encode_words(packs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(chunk, part, counts, ids) of packs of words (chunk, part, sizes, text). All packs of a part meet in one task, one
    after the other, and a word that was encoded for one of them is not encoded again for the next."""
    text = vocab.text

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known, current = Vocabulary.encoder(text), {}, None
        for batch in batches:
            out = []
            for part, sizes, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "sizes", "text"))):
                if part != current:
                    known, current = {}, part
                words = unpack_words(sizes, packed)
                new = [w for w in words if w not in known]
                known |= zip(new, (np.array(e.ids, "<u4") for e in t.encode_batch(new, add_special_tokens=False)))
                found = [known[w] for w in words]
                out.append((pack(np.fromiter(map(len, found), np.int64, len(found))), pack(np.concatenate(found))))
            columns = [batch.column("chunk"), batch.column("part"), *(pa.array([r[k] for r in out], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "counts", "ids"])

    dealt = packs.repartition(partitions(packs.sparkSession), "part").sortWithinPartitions("part")
    return dealt.mapInArrow(encode, "chunk long, part int, counts binary, ids binary")


#: Words of a document that are strung together at a time, and bytes of ids that are handed on at a time.
PIECE, HANDED = 1 << 20, 1 << 22


def text_of(ids: np.ndarray, pieces: list[bytes]) -> str:
    return b"".join(map(pieces.__getitem__, ids[ids < len(pieces)].tolist())).decode("utf-8", "replace")


def string_together(chunks: DataFrame, pieces: list[bytes] | None = None) -> DataFrame:
    """(doc_id, ids) of chunks that have got the ids of their words; with ``pieces`` also the ids' text, ``decoded``."""
    names = ["doc_id", "ids"] + (["decoded"] if pieces else [])

    def documents(row) -> Iterator[bytes]:
        found = sorted(row["found"], key=lambda r: r["part"])
        place = unpack(row["places"]).astype(np.int64)
        lengths = np.concatenate([unpack(r["counts"]) for r in found] or [place]).astype(np.int64)
        flat = np.concatenate([unpack(r["ids"]) for r in found] or [np.zeros(0, "<u4")])
        counts, starts = np.empty_like(lengths), np.empty_like(lengths)
        counts[place], starts[place] = lengths, np.cumsum(lengths) - lengths
        sizes, words = unpack(row["sizes"]).astype(np.int64), unpack(row["words"])
        for e, size in zip(np.cumsum(sizes).tolist(), sizes.tolist()):
            parts = []
            for lo in range(e - size, e, PIECE):
                own = words[lo : min(e, lo + PIECE)]
                n = counts[own]
                parts.append(flat[np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
            yield b"".join(parts)

    def batch_of(doc_ids, ids):
        columns = [pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())]
        if pieces:
            columns.append(pa.array([text_of(np.frombuffer(x, "<u4"), pieces) for x in ids], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                doc_ids, out, size = [], [], 0
                for doc_id, ids in zip(row["doc_ids"], documents(row)):
                    doc_ids.append(doc_id)
                    out.append(ids)
                    size += len(ids)
                    if size > HANDED:
                        yield batch_of(doc_ids, out)
                        doc_ids, out, size = [], [], 0
                yield batch_of(doc_ids, out)

    schema = "doc_id long, ids binary" + (", decoded string" if pieces else "")
    return chunks.select("doc_ids", "sizes", "words", "places", "found").mapInArrow(build, schema)


def encode(docs: DataFrame, vocab_path: str, doc_id: str = "doc_id", text: str = "text", chunk_chars: int = CHUNK_CHARS, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): one row for each row of ``docs``, repeated ones too, with the ids of its whole text as 32-bit
    little-endian numbers. Null texts count as empty and have no ids; other columns are not read. With ``decoded`` the ids
    are decoded again in the same task (see ``decode``)."""
    spark = docs.sparkSession
    vocab, stage, n = Vocabulary(vocab_path), Stage(spark, "bpe"), partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    name = f"bpe_chunks_{uuid.uuid4().hex}"
    chunks = split_chunks(rows, vocab, chunk_chars, PARTS * n).write.bucketBy(n, "chunk").option("path", f"{stage.root}/chunks")
    chunks.option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    packs = chunks.select("chunk", F.inline("distinct"))
    found = encode_words(packs, vocab).groupBy("chunk").agg(F.collect_list(F.struct("part", "counts", "ids")).alias("found"))  # the packs of one chunk
    joined = chunks.select("chunk", "doc_ids", "sizes", "words", "places").join(found, "chunk", "left")
    none = F.array().cast("array<struct<part:int,counts:binary,ids:binary>>")
    return string_together(joined.withColumn("found", F.coalesce("found", none)), vocab.pieces if decoded else None)


def decode(encoded: DataFrame, vocab_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the text of the ids, special tokens included. Ids without a piece stand for nothing, null ids for
    an empty text."""
    pieces = Vocabulary(vocab_path).pieces

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([text_of(np.frombuffer(own.as_py() or b"", "<u4"), pieces) for own in batch], pa.string())

    return encoded.withColumn("decoded", F.arrow_udf(join, "string")(F.col(ids)))


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, the SHA-256 of ids and decoded text, and ``more`` columns."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"), *more)
