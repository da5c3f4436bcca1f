"""Operator 12, byte-level BPE by merge ranks with a queue over a hierarchical bitmap.

The tokens of a pre-token are a linked list of positions. A pair of neighbours whose joined bytes have a rank waits in the
bucket of that rank. A bitmap has a bit for each rank whose bucket is not empty, 256 to a word, and a word above has a bit for
each word that is not empty; find-first-set in the upper word and then in the lower one is the lowest waiting rank. A merge
changes the pairs on its two sides; their former entries stay in the buckets and are skipped when they come up, since each position knows
the rank it waits for. Positions of one rank come up from the left, and a lower rank that a merge makes possible comes before
the rest of its bucket, so the ids are those of "merge the leftmost pair of the lowest rank" for any table of ranks. A
pre-token of n bytes takes n steps of a few words each, whatever its length.
"""

from __future__ import annotations

import base64
import itertools
import re
import struct
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.bpe import BEYOND_LATIN, LATIN

#: Ranks of a word of the bitmap.
BITS = 8
WIDTH, MASK = 1 << BITS, (1 << BITS) - 1
#: Pre-tokens whose ids a task remembers (at most twice as many), and the longest of them in characters.
MEMO, REMEMBERED = 250_000, 32
#: Texts of more characters are cut into pre-tokens bit by bit, so many at a time.
LONG, AT_ONCE = 1 << 20, 1 << 16
#: Bytes of ids that are handed on at a time.
HANDED = 1 << 22


class RankQueue:
    """The merges of one pre-token after another: positions by rank, the lowest rank first, the leftmost position of it first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = 1 + max(ranks.values())
        self.buckets: list[list[int]] = [[] for _ in range(size)]
        self.low = [0] * (1 + size // WIDTH)
        self.bit = [1 << k for k in range(max(WIDTH, len(self.low)))]
        self.two = [ranks.get(bytes(divmod(k, 256)), -1) for k in range(1 << 16)]
        self.after, self.before = list(range(1, REMEMBERED + 1)), list(range(-1, REMEMBERED - 1))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token; all buckets are empty before and after."""
        n, rank_of = len(piece), self.ranks.get
        if (whole := rank_of(piece)) is not None:
            return [whole]
        buckets, low, bit, top = self.buckets, self.low, self.bit, 0
        after, before = (self.after[:n], self.before[:n]) if n <= REMEMBERED else (list(range(1, n + 1)), list(range(-1, n - 1)))
        two, last, waits = self.two, piece[0], []
        for byte in piece[1:]:
            waits.append(two[last << 8 | byte])
            last = byte
        waits.append(-1)
        for position, rank in enumerate(waits):
            if rank >= 0:
                if not buckets[rank]:
                    word = rank >> BITS
                    low[word] |= bit[rank & MASK]
                    top |= bit[word]
                buckets[rank].append(position)
        while top:
            word = (top & -top).bit_length() - 1
            rank = word << BITS | (low[word] & -low[word]).bit_length() - 1
            bucket = buckets[rank]
            left = heappop(bucket)
            if not bucket:
                low[word] ^= bit[rank & MASK]
                if not low[word]:
                    top ^= bit[word]
            if waits[left] != rank:  # stale: one of the two has been merged since
                continue
            right = after[left]
            stop = after[left] = after[right]
            waits[right] = -1
            if stop < n:
                before[stop] = left
                waits[left] = new = rank_of(piece[left : after[stop]], -1)
                if new >= 0:
                    if buckets[new]:
                        heappush(buckets[new], left)  # positions mostly come in order, which takes one step
                    else:
                        buckets[new].append(left)
                        low[new >> BITS] |= bit[new & MASK]
                        top |= bit[new >> BITS]
            else:
                waits[left] = -1
            left = before[left]
            if left >= 0:
                waits[left] = new = rank_of(piece[left:stop], -1)
                if new >= 0:
                    if buckets[new]:
                        heappush(buckets[new], left)
                    else:
                        buckets[new].append(left)
                        low[new >> BITS] |= bit[new & MASK]
                        top |= bit[new >> BITS]
        out, start, ranks = [], 0, self.ranks
        while start < n:
            stop = after[start]
            out.append(ranks[piece[start:stop]])
            start = stop
        return out


class Ranks:
    """A rank file: the id of every piece, and the piece of every id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.lines = f.read()

    @staticmethod
    def of(lines: bytes) -> dict[bytes, int]:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines.splitlines()) if piece}

    @property
    def pieces(self) -> list[bytes]:
        ranks = self.of(self.lines)
        out = [b""] * (1 + max(ranks.values()))
        for piece, rank in ranks.items():
            out[rank] = piece
        return out


class Encoder(dict):
    """Ids of pre-tokens as 32-bit little-endian bytes. Short ones are remembered: when there are too many, those that have
    not been met again since the last time are forgotten."""

    def __init__(self, lines: bytes, pattern: str):
        import regex

        self.merge, self.older = RankQueue(Ranks.of(lines)).merge, {}
        self.full = regex.compile(pattern)
        # texts of the Latin blocks are cut by the same pattern as the standard module has it, which is faster
        self.latin = re.compile(LATIN) if pattern == public_tokenizers.PATTERN else self.full
        self.beyond = re.compile(BEYOND_LATIN).search

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            merged = self.merge(word.encode())
            ids = struct.pack(f"<{len(merged)}I", *merged)
        if len(word) <= REMEMBERED:
            if len(self) >= MEMO:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        cut = self.full if self.beyond(text) else self.latin
        if len(text) <= LONG:
            return b"".join(map(self.__getitem__, cut.findall(text)))
        words = (m.group() for m in cut.finditer(text))
        return b"".join(iter(lambda: b"".join(map(self.__getitem__, itertools.islice(words, AT_ONCE))), b""))


def encode(docs: DataFrame, rank_path: str, pattern: str = public_tokenizers.PATTERN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): one row for each row of ``docs``, repeated ones too, with the ids of its whole text as 32-bit
    little-endian numbers. There are no special tokens; their strings are text. Null and empty texts have no ids, an empty
    table no rows; other columns are not read, whatever their names. Nothing is shuffled."""
    lines = Ranks(rank_path).lines

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(lines, pattern)
        batch_of = lambda doc_ids, ids: pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        for batch in batches:
            doc_ids, ids, size = [], [], 0
            for own, whole in zip(batch.column(0), batch.column(1)):
                doc_ids.append(own.as_py())
                ids.append(encoder.encode(whole.as_py()))
                size += len(ids[-1])
                if size > HANDED:
                    yield batch_of(doc_ids, ids)
                    doc_ids, ids, size = [], [], 0
            if doc_ids:
                yield batch_of(doc_ids, ids)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, rank_path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``: the bytes of the ids, which need not be whole characters. Ids without a piece stand for nothing, null
    ids for no bytes. The piece table has a row for each line of the rank file and no more, so it travels to every task."""
    pieces = Ranks(rank_path).pieces

    def join(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for own in batch:
                numbers = np.frombuffer(own.as_py() or b"", "<u4")
                out.append(b"".join(map(pieces.__getitem__, numbers[numbers < len(pieces)].tolist())))
            yield pa.array(out, pa.binary())

    return encoded.withColumn("decoded", F.arrow_udf(join, "binary")(F.col(ids)))


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of ids and decoded bytes."""
    return encoded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
