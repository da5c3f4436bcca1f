"""Operator 10, token ids as binary shards in training order.

Every sequence of ``length`` ids has a number from 0 to N - 1 by its document and place; a keyed Feistel permutation of the
next power of four, repeated until it falls below N (cycle-walking), gives it a slot of its own. A shard holds the same
number of consecutive slots as records of one fixed stride, so slot s is at a known offset of a known shard: reading in
training order is sequential and can go on from any slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import numbered, partitions
from planloom.staging import Stage

#: Ids of a sequence, records of a shard and rounds of the permutation.
LENGTH, SHARD, ROUNDS = 512, 4096, 6
#: Byte ids: 0 fills up, 1 ends a document, byte b has the id b + 2.
PAD, END, FIRST_BYTE = 0, 1, 2
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)  # fixed values of a usual 64-bit finaliser
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced domain with at least ``n`` elements."""
    return max(1, -(-max(0, n - 1).bit_length() // 2))


def feistel(x: np.ndarray, bits: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. 4**bits - 1."""
    mask = U((1 << bits) - 1)
    left, right = x >> U(bits), x & mask
    keys = mix(U(key % (1 << 64)) + np.arange(1, ROUNDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    for k in keys[::-1] if inverse else keys:
        if inverse:
            left, right = right ^ (mix(left ^ k) & mask), left
        else:
            left, right = right, left ^ (mix(right ^ k) & mask)
    return (left << U(bits)) | right


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A permutation of 0 .. n - 1: walks along a cycle of the larger domain until it is back below n."""
    with np.errstate(over="ignore"):
        bits = half_bits(n)
        out = feistel(x.astype(U), bits, key, inverse)
        while (beyond := out >= U(n)).any():
            out[beyond] = feistel(out[beyond], bits, key, inverse)
        return out.astype(np.int64)


def byte_ids(text: str = "text"):
    """The bytes of a text, its token ids less ``FIRST_BYTE``, as binary; null counts as empty."""
    return F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8")


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, packed) of (doc_id, key, ids): documents move in this form, which takes less room than their rows do."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            small = pa.array([compress(x.as_py()) for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), small], names=["doc_id", "key", "packed"])

    return docs.mapInArrow(pack, "doc_id long, key string, packed binary")


def cut(docs: DataFrame, stage: Stage, length: int) -> tuple[DataFrame, int]:
    """(doc_id, first, packed) of (doc_id, key, ids as bytes), and how many sequences there are: ``first`` is the number of the
    document's first sequence. Its last sequence ends with END, so even an empty document is one."""
    no_id = F.lit(-(1 << 63))
    size = F.floor(F.octet_length("ids") / length) + 1
    counts = docs.groupBy("doc_id", "key").agg(F.sum(size).alias("n"), F.count(F.lit(1)).alias("rows"), F.max(size).alias("each"))
    order = stage.write(numbered(counts, ["doc_id", "key"], stage, F.col("n")))
    total = order.agg(F.sum("n")).first()[0] or 0
    # equal rows are told apart by a copy number; nearly always there is one
    copies = order.select(F.coalesce("doc_id", no_id).alias("id"), "key", "each", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("copy"))
    firsts = copies.select("id", "key", (F.col("base") + F.col("copy") * F.col("each")).alias("first"))
    rows = packed(docs).withColumn("id", F.coalesce("doc_id", no_id))
    return rows.dropDuplicates(["id", "key"]).join(firsts, ["id", "key"]).select("doc_id", "first", "packed"), total


#: Bytes of sequences that are handed on at a time.
HANDED = 1 << 22


def slotted(documents: DataFrame, total: int, key: int, length: int) -> DataFrame:
    """(slot, doc_id, piece, ids) of (doc_id, first, packed): each piece of ``length`` bytes has the slot of its number."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress

        def make(firsts, doc_ids, texts):
            counts = np.array([len(t) // length + 1 for t in texts])
            piece = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            slots = permute(np.repeat(np.array(firsts), counts) + piece, total, key)
            ids = [t[k : k + length] for t in texts for k in range(0, len(t) // length * length + 1, length)]
            columns = [slots, [d for d, n in zip(doc_ids, counts.tolist()) for _ in range(n)], piece, ids]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, kinds)], names=["slot", "doc_id", "piece", "ids"])

        for batch in batches:
            firsts, doc_ids, texts, size = [], [], [], 0
            for doc_id, first, small in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "first", "packed"))):
                firsts.append(first)
                doc_ids.append(doc_id)
                texts.append(expand(small))
                size += len(texts[-1])
                if size > HANDED:
                    yield make(firsts, doc_ids, texts)
                    firsts, doc_ids, texts, size = [], [], [], 0
            if texts:
                yield make(firsts, doc_ids, texts)

    return documents.mapInArrow(pieces, "slot long, doc_id long, piece int, ids binary")


def records(pieces: list[bytes], length: int) -> bytes:
    """Fixed-stride records of 16-bit little-endian ids: bytes shifted by ``FIRST_BYTE``, END after the last piece of a
    document (a full piece is never the last), PAD up to ``length``."""
    out = np.full((len(pieces), length), PAD, "<u2")
    for row, piece in zip(out, pieces):
        row[: len(piece)] = np.frombuffer(piece, np.uint8).astype("<u2") + FIRST_BYTE
        if len(piece) < length:
            row[len(piece)] = END
    return out.tobytes()


def shards(sequences: DataFrame, length: int, per_shard: int) -> DataFrame:
    """(shard, first_slot, n_sequences, stride, payload) of sequences with slots. Slots are dealt out by range of shards and
    sorted, so a task builds one shard after the other and holds one at a time."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, first, pieces = None, 0, []

        def shard():
            row = [current, first, len(pieces), 2 * length, records(pieces, length)]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["shard", "first_slot", "n_sequences", "stride", "payload"])

        for batch in batches:
            for slot, piece in zip(batch.column("slot").to_pylist(), batch.column("ids").to_pylist()):
                if slot // per_shard != current:
                    if pieces:
                        yield shard()
                    current, first, pieces = slot // per_shard, slot, []
                pieces.append(piece)
        if pieces:
            yield shard()

    n = partitions(sequences.sparkSession)
    dealt = sequences.select("slot", "ids", F.floor(F.col("slot") / per_shard).alias("shard")).repartitionByRange(n, "shard").sortWithinPartitions("slot").select("slot", "ids")
    return dealt.mapInArrow(build, "shard long, first_slot long, n_sequences int, stride int, payload binary")


def materialise(docs: DataFrame, key: int = 10, length: int = LENGTH, per_shard: int = SHARD, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Writes the shards as a table in the shared folder and returns (shards, index): the table, and slot, shard, offset,
    doc_id and piece of every sequence.

    ``docs`` are numbered by doc_id (null first), equal ids by a hash of the text, so the order does not depend on how the
    rows are stored. Repeated rows are sequences of their own. Null texts count as empty; other columns are not read. An
    empty table has no shards.
    """
    stage = Stage(docs.sparkSession, "shards")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), byte_ids(text).alias("ids")).withColumn("key", F.md5("ids"))
    documents, total = cut(rows, stage, length)
    sequences = slotted(documents, total, key, length)
    path = f"{stage.root}/shards"
    built = shards(sequences, length, per_shard)
    built.write.option("compression", "zstd").parquet(path)
    table = docs.sparkSession.read.schema(built.schema).parquet(path)
    place = sequences.select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), (F.col("slot") % per_shard * (2 * length)).alias("offset"), "doc_id", "piece")
    return table, place


def read_from(shard_table: DataFrame, slot: int, length: int = LENGTH, per_shard: int = SHARD) -> DataFrame:
    """(slot, ids) from ``slot`` on, in training order within each shard: whole shards before it are not read."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, payload in zip(batch.column("first_slot").to_pylist(), batch.column("payload").to_pylist()):
                ids = np.frombuffer(payload, "<u2").reshape(-1, length)[max(0, slot - first) :]
                slots = np.arange(max(first, slot), max(first, slot) + len(ids))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length), pa.array(ids.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(slots), lists], names=["slot", "ids"])

    later = shard_table.where(F.col("shard") >= slot // per_shard).select("first_slot", "payload")
    return later.mapInArrow(split, "slot long, ids array<int>")
