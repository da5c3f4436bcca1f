"""Operator 7, near-duplicates by DartMinHash.

A document is the bag of its five-word shingles, weighted by their counts. Every element of the plane (weight, rank) of a
shingle is hit by random darts that depend on the shingle alone; a dart belongs to a document if it lies below the shingle's
weight there, and to one coordinate of the signature. The signature keeps the dart of the lowest rank for each coordinate, so
two documents agree in a coordinate with a probability equal to their generalised Jaccard similarity. Darts are thrown by
ascending rank until every coordinate is filled, which takes time in proportion to shingles plus coordinates.

Bands of the signature put texts into buckets. A bucket's texts are first compared with its head, the text whose buckets
hold the most texts; linked texts make up a class (connected components by hooking and jumping). Then every pair of a
bucket whose signatures may be similar enough and whose texts are not in one class yet is a candidate: first the likeliest
of each text, then, classes having grown, all that are left. Texts with candidates left get a second signature, seven times
as long, and a pair leaves its task only if that one agrees, so texts that are somewhat alike (0.7, say) stay within tasks.
No text leaves a bucket, only pairs that are known to be in one class are passed over. Large buckets are cut into blocks and
every two blocks meet in a task. Candidates are decided on whole texts, exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import partitions, salted_join
from planloom.staging import Stage

SHINGLE, LEAST = 5, 0.8
#: Bands of a signature and coordinates of a band: a pair of similarity 0.8 is proposed with a probability of 0.9995.
BANDS, ROWS = 25, 6
#: Rows of a bucket that meet in one task (about): two blocks of half as many.
WALKED = 4096
#: Share of equal coordinates from which two texts are candidates (3.7 standard errors below 0.8).
MAY = 0.68
#: Candidates that a text of a bucket has in the first round, the likeliest ones; the second round has no limit.
FIRST = 4
#: Coordinates of the second signature, and the share of them that candidates of the second round have in common (3.2
#: standard errors below 0.8).
LONGER, STILL = 1024, 0.76
#: Candidates that a task holds before it hands them on.
HELD = 100_000
WORD = re.compile(r"\w+")
#: Stands for a null doc_id: after all others.
NO_ID = (1 << 63) - 1
U = np.uint64
#: Odd multipliers of the usual 64-bit finalisers (fixed values).
M1, M2, GOLDEN = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * M1
    x = (x ^ (x >> U(27))) * M2
    return x ^ (x >> U(31))


def unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(float) * 2.0**-53


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the runs of five words, case and punctuation aside. A text of fewer words is one shingle; so is a
    text without any word, by its characters between white space at both ends."""
    from xxhash import xxh64_intdigest

    words = WORD.findall(text.lower())
    h = np.fromiter(map(xxh64_intdigest, words), U, len(words))
    if not len(h):
        return np.array([xxh64_intdigest(rest) if (rest := text.strip()) else 0], U), np.ones(1, np.int64)
    n = max(1, len(h) - SHINGLE + 1)
    out = np.full(n, U(len(h) if len(h) < SHINGLE else SHINGLE))
    for k in range(min(SHINGLE, len(h))):
        out = mix(out * GOLDEN + h[k : k + n])
    return np.unique(out, return_counts=True)


def poisson_table(mean: float) -> np.ndarray:
    k = np.arange(int(mean + 12 * mean**0.5 + 20))
    return np.cumsum(np.exp(k * np.log(mean) - mean - np.array([np.sum(np.log(np.arange(1, i + 1))) for i in k])))


class Darts:
    """Signatures of ``size`` coordinates. Ranks are cut into [0, 1), [1, 2), [2, 4), ..., weights likewise; each field of
    that grid holds a Poisson number of darts, one for each unit of area on average."""

    def __init__(self, size: int):
        self.size = size
        self.tables: dict[float, np.ndarray] = {}

    def field(self, elements, weights, owners, w_lo, w_hi, r_lo, r_hi):
        """Darts of one field: owners, coordinates, ranks, names."""
        inside = weights > w_lo
        elements, weights, owners = elements[inside], weights[inside], owners[inside]
        seed = mix(elements ^ mix(np.full(1, U(int(w_lo) * 1_000_003 + int(r_lo) + 1)) * GOLDEN))
        area = (w_hi - w_lo) * (r_hi - r_lo)
        if area not in self.tables:
            self.tables[area] = poisson_table(area)
        n = np.searchsorted(self.tables[area], unit(mix(seed)))
        number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        dart = mix(np.repeat(seed, n) + (number.astype(U) + U(1)) * GOLDEN)
        hit = w_lo + (w_hi - w_lo) * unit(mix(dart ^ M1)) < np.repeat(weights, n)
        dart, owners = dart[hit], np.repeat(owners, n)[hit]
        return owners, (mix(dart ^ GOLDEN) % U(self.size)).astype(np.int64), r_lo + (r_hi - r_lo) * unit(mix(dart ^ M2)), dart

    def signatures(self, bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """One row of dart names for each bag (elements, weights); a bag of weight 0 has zeros."""
        elements, weights = np.concatenate([e for e, _ in bags]), np.concatenate([w for _, w in bags]).astype(float)
        owners = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
        rank, name = np.full(len(bags) * self.size, np.inf), np.zeros(len(bags) * self.size, U)
        r_lo = 0.0
        while len(elements):
            r_hi, w_lo, most = max(1.0, 2 * r_lo), 0.0, weights.max()
            while w_lo < most:
                w_hi = max(1.0, 2 * w_lo)
                # in parts, so that the darts of long texts stay few at a time
                for lo in range(0, len(elements), self.part(r_hi - r_lo)):
                    own = slice(lo, lo + self.part(r_hi - r_lo))
                    owner, at, r, dart = self.field(elements[own], weights[own], owners[own], w_lo, w_hi, r_lo, r_hi)
                    at += owner * self.size
                    np.minimum.at(rank, at, r)
                    first = rank[at] == r
                    name[at[first]] = dart[first]
                w_lo = w_hi
            # whatever has all its coordinates is done: later darts have higher ranks
            unfilled = ~np.isfinite(rank).reshape(len(bags), self.size).all(axis=1)
            going = unfilled[owners]
            elements, weights, owners, r_lo = elements[going], weights[going], owners[going], r_hi
        return name.reshape(len(bags), self.size)

    @staticmethod
    def part(height: float) -> int:
        return max(1, int(500_000 / height))


#: Shingles whose signatures are made at a time (one text may have more).
TOGETHER = 100_000


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, bands, coordinates): the MD5 of the text, a hash for each band of its signature, and one byte for
    each of its coordinates."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts = Darts(bands * rows)
        number = np.arange(bands, dtype=U)

        small: list[bytes] = []

        def keys(bags):
            signed = darts.signatures(bags).reshape(len(bags), bands, rows)
            out = np.tile(number, (len(bags), 1))
            for k in range(rows):
                out = mix(out * GOLDEN + signed[:, :, k])
            small.extend(x.tobytes() for x in (signed >> U(56)).astype(np.uint8))
            return out.view(np.int64).ravel()

        for batch in batches:
            out, bags, size = [], [], 0
            small.clear()
            for text in batch.column("text"):
                bags.append(shingles(text.as_py()))
                size += len(bags[-1][0])
                if size > TOGETHER:
                    out.append(keys(bags))
                    bags, size = [], 0
            if bags:
                out.append(keys(bags))
            flat = pa.array(np.concatenate(out) if out else np.zeros(0, np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)
            columns = [batch.column("doc_id"), batch.column("text_key"), lists, pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "bands", "coordinates"])

    return docs.select("doc_id", F.md5("text").alias("text_key"), "text").mapInArrow(build, "doc_id long, text_key string, bands array<long>, coordinates binary")


def longer(texts: DataFrame) -> DataFrame:
    """(node, longer) of (node, text): one byte for each coordinate of the second signature."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        darts = Darts(LONGER)
        for batch in batches:
            out, bags, size = [], [], 0

            def signed():
                return [x.tobytes() for x in (darts.signatures(bags) >> U(56)).astype(np.uint8)]

            for text in batch.column("text"):
                bags.append(shingles(text.as_py()))
                size += len(bags[-1][0])
                if size > TOGETHER:
                    out += signed()
                    bags, size = [], 0
            if bags:
                out += signed()
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.binary())], names=["node", "longer"])

    return texts.select("node", "text").mapInArrow(build, "node long, longer binary")


def alike(pairs: DataFrame, coordinates: DataFrame) -> DataFrame:
    """The staged ``pairs`` (a, b) whose signatures agree in a share of MAY or more. ``coordinates``: (node, coordinates)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= MAY))

    one = salted_join(pairs.withColumnRenamed("b", "node"), coordinates, "node").select("a", F.col("node").alias("b"), F.col("coordinates").alias("y"))
    two = salted_join(one, coordinates.select(F.col("node").alias("a"), F.col("coordinates").alias("x")), "a", counted=pairs)
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def against_heads(entries: DataFrame, stage: Stage) -> DataFrame:
    """(a, b), a > b, of staged (bucket, node, n): every text of a bucket with the head, the text whose buckets have the most
    rows (the smallest node of several)."""
    weights = entries.groupBy("node").agg(F.sum("n").alias("weight"))
    heads = entries.join(weights, "node").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("node")).alias("node"))).alias("head"))
    met = salted_join(entries.select("bucket", "node"), heads.select("bucket", (-F.col("head.node")).alias("head")), "bucket").where("node <> head")
    return stage.write(met.select(F.greatest("node", "head").alias("a"), F.least("node", "head").alias("b")).distinct())


def blocks_of(entries: DataFrame, roots: DataFrame, stage: Stage) -> DataFrame:
    """(bucket, part, i, j, side, node, root) of the buckets with texts of several classes.

    The rows of a bucket's largest class are dealt to blocks, and so are all others. Part 0 has every two blocks of the others
    (side is the block), part 1 every block of the others with every one of the largest class (side -1), so that any two
    texts of different classes meet once. A class is never compared with itself, so a bucket of one large class and a few
    other texts is copied a few times only."""
    rooted = stage.write(entries.select("bucket", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    counts = rooted.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"))
    open_ = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root")).alias("top")).where("top.c < n")
    half = max(1, WALKED // 2)
    n_blocks = lambda c: F.ceil(c / half).cast("int")
    open_ = open_.select("bucket", F.col("top.root").alias("top"), n_blocks(F.col("n") - F.col("top.c")).alias("others"), n_blocks(F.col("top.c")).alias("tops"), (F.col("n") - F.col("top.c") > 1).alias("several"))
    rows = salted_join(rooted, open_, "bucket")
    is_top = F.col("root") == F.col("top")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.when(is_top, F.col("tops")).otherwise(F.col("others"))).cast("int"))
    to = lambda n: F.sequence(F.lit(0), n - 1)
    at = lambda part, i, j, side: F.struct(F.lit(part).alias("part"), i.alias("i"), j.alias("j"), side.alias("side"))
    own = F.col("own")
    with_top = F.transform(to(F.col("tops")), lambda k: at(1, own, k, own))
    each_other = F.transform(to(F.col("others")), lambda k: at(0, F.least(own, k), F.greatest(own, k), own))
    top_places = F.transform(to(F.col("others")), lambda k: at(1, k, own, F.lit(-1)))
    places = F.when(is_top, top_places).when(F.col("several"), F.concat(with_top, each_other)).otherwise(with_top)
    return rows.select("bucket", "node", "root", F.explode(places).alias("at")).select("bucket", "at.*", "node", "root")


def unlinked(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, signed: np.ndarray, more: np.ndarray | None, first: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(texts, texts): the candidates of two blocks, or of the texts of one block, that are not in one class; of each text
    only the likeliest ``first`` if given, and only those alike in their second signatures ``more`` if given."""
    one = (sides == sides[0]).all()
    left = np.arange(len(nodes)) if one else np.flatnonzero(sides == sides.max())
    right = left if one else np.flatnonzero(sides != sides.max())
    there, least = signed[right], MAY * signed.shape[1]
    for k, i in enumerate(left):
        skip = k + 1 if one and first is None else 0
        same = np.count_nonzero(there[skip:] == signed[i], axis=1)
        found = np.flatnonzero((same >= least) & (roots[right[skip:]] != roots[i]))
        if first is not None and len(found) > first:
            found = found[np.argsort(-same[found], kind="stable")[:first]]
        found = right[skip:][found]
        if more is not None and len(found):
            found = found[np.count_nonzero(more[found] == more[i], axis=1) >= STILL * more.shape[1]]
        if len(found):
            yield np.full(len(found), nodes[i]), nodes[found]


def met(rows: DataFrame, *signatures: str) -> tuple[DataFrame, list[str]]:
    """The rows of ``blocks_of`` with signatures, two blocks after each other in one task, and the columns of a block."""
    key = ["bucket", "part", "i", "j"]
    dealt = rows.repartition(partitions(rows.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.select(*key, "node", "root", "side", *signatures), key


def blocks(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[np.ndarray]]:
    """Nodes, roots, sides and signatures of each two blocks."""
    current, group = None, []

    def arrays():
        nodes, roots, sides, *signatures = zip(*group)
        return [*(np.array(x) for x in (nodes, roots, sides)), *(np.frombuffer(b"".join(x), np.uint8).reshape(len(group), -1) for x in signatures)]

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
        for row in zip(*columns):
            if row[: len(key)] != current:
                if len(group) > 1:
                    yield arrays()
                current, group = row[: len(key)], []
            group.append(row[len(key) :])
    if len(group) > 1:
        yield arrays()


def candidates_of(rows: DataFrame, first: int | None, *more: str) -> DataFrame:
    """(a, b), a > b, of the rows of ``blocks_of`` with coordinates, and with the second signature where ``more`` names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed():
            x, y = (np.concatenate(c) for c in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], names=["a", "b"])

        found, held = [], 0
        for nodes, roots, sides, signed, *second in blocks(batches, key):
            for pair in unlinked(nodes, roots, sides, signed, second[0] if second else None, first):
                found.append(pair)
                held += len(pair[0])
                if held >= HELD:
                    yield packed()
                    found, held = [], 0
        if found:
            yield packed()

    dealt, key = met(rows, "coordinates", *more)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def still_open(rows: DataFrame) -> DataFrame:
    """(node): the texts that have a candidate in another class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for nodes, roots, sides, signed in blocks(batches, key):
            own = [np.unique(np.concatenate(pair)) for pair in unlinked(nodes, roots, sides, signed, None, None)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(own)))], names=["node"])

    dealt, key = met(rows, "coordinates")
    return dealt.mapInArrow(run, "node long").distinct()


def similarity(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of (a, b, text_a, text_b): the exact generalised Jaccard similarity of the shingle bags."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = {}
        for batch in batches:
            out = []
            for b, text_a, text_b in zip(batch.column("b").to_pylist(), batch.column("text_a"), batch.column("text_b")):
                if b not in last:
                    last = {b: shingles(text_b.as_py())}  # rows of the same text follow each other
                (x, n), (y, m) = shingles(text_a.as_py()), last[b]
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common = np.minimum(n[i], m[j]).sum()
                out.append(common / (n.sum() + m.sum() - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "similarity"])

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long, similarity double")


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, root): the smallest node of each node's component. ``edges`` (a, b) with a > b, staged.

    Every round hooks the roots of an edge's ends to the smaller one and lets nodes jump to their root's root; edges within
    one tree are dropped. Hooks are minima, so nothing is collected, and the lookups spread their hot roots."""
    trees = stage.write(edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct().withColumn("root", F.col("node")))
    open_edges = edges
    while not open_edges.isEmpty():
        lower = open_edges.groupBy(F.col("a").alias("root")).agg(F.min("b").alias("to"))
        # hooks point to smaller nodes only, so they form trees; jump until they are flat
        hooks = stage.write(lower)
        while True:
            step = stage.write(salted_join(hooks.withColumnRenamed("root", "from").withColumnRenamed("to", "root"), hooks.select("root", F.col("to").alias("next")), "root", "left")
                               .select(F.col("from").alias("root"), F.coalesce("next", "root").alias("to"), F.col("next").isNotNull().alias("moved")))
            hooks = step.select("root", "to")
            if step.where("moved").isEmpty():
                break
        trees = stage.write(salted_join(trees, hooks, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        ends = stage.write(salted_join(open_edges.withColumnRenamed("a", "root"), hooks, "root", "left").select(F.coalesce("to", "root").alias("x"), "b"))
        ends = stage.write(salted_join(ends.withColumnRenamed("b", "root"), hooks, "root", "left").select("x", F.coalesce("to", "root").alias("y")))
        open_edges = stage.write(ends.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    return trees


def classes(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, text_key, class_id, keeper): a row for each row of ``docs``. ``class_id`` is the smallest doc_id of the class
    and ``keeper`` marks one row of each class, of that doc_id.

    Equal texts, and texts linked by a similarity of ``least`` or more, are in one class. Null texts count as empty, and
    empty texts are equal, as are texts of white space only; other texts without words are equal if their characters are. Repeated rows are copies of each other: one of them is the keeper. Null doc_ids are never the
    smallest unless a class has no other.
    """
    stage = Stage(docs.sparkSession, "near_dedup")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stage.write(sketch(whole, bands, rows).withColumn("row", F.monotonically_increasing_id()))
    # one node for each different text; nodes are numbered once, in a written table
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "row")).alias("first")
    texts = stage.write(signed.groupBy("text_key").agg(first, F.min("bands").alias("bands"), F.min("coordinates").alias("coordinates")).withColumn("node", F.monotonically_increasing_id()))
    entries = texts.select("node", F.posexplode("bands").alias("band", "key")).select("node", F.xxhash64("band", "key").alias("bucket"))
    sizes = entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = stage.write(entries)
    entries = stage.write(salted_join(entries, sizes, "bucket"))
    signatures = stage.write(texts.select("node", "coordinates").join(entries.select("node").distinct(), "node"))
    chosen = stage.write(texts_of(signatures.select("node"), texts, whole))

    def linked(pairs: DataFrame) -> DataFrame:
        return stage.write(similarity(with_texts(pairs, chosen)).where(F.col("similarity") >= least).select("a", "b"))

    asked = stage.write(alike(against_heads(entries, stage), signatures))
    links = linked(asked)
    roots = components(links, stage)
    found = stage.write(candidates_of(blocks_of(entries, roots, stage).join(signatures, "node"), FIRST).join(asked, ["a", "b"], "left_anti"))
    more = linked(found)
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = components(links, stage)
    rest = blocks_of(entries, roots, stage).join(signatures, "node")
    second = stage.write(longer(chosen.join(still_open(rest), "node", "left_semi")))
    found = stage.write(candidates_of(rest.join(second, "node"), None, "longer").join(asked.unionByName(found), ["a", "b"], "left_anti"))
    more = linked(found)
    if not more.isEmpty():
        roots = components(links.unionByName(more), stage)
    grouped = stage.write(texts.select("node", "text_key", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    best = grouped.groupBy("root").agg(F.min("first").alias("best"))
    named = salted_join(grouped.select("root", "text_key"), best, "root").select("text_key", "best")
    out = salted_join(signed.select("text_key", "doc_id", "row"), named, "text_key")
    real = F.when(F.col("best.doc_id") < NO_ID, F.col("best.doc_id"))
    return out.select("doc_id", "text_key", real.alias("class_id"), (F.col("row") == F.col("best.row")).alias("keeper"))


def texts_of(nodes: DataFrame, texts: DataFrame, whole: DataFrame) -> DataFrame:
    """(node, text) of the nodes; each text comes from the row of its smallest doc_id."""
    keys = texts.join(nodes, "node").select("node", F.col("first.doc_id").alias("id"), "text_key")
    rows = whole.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.md5("text").alias("text_key"), "text")
    return rows.join(keys, ["id", "text_key"]).groupBy("node").agg(F.first("text").alias("text"))


def with_texts(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of staged ``pairs``; equal b follow each other."""
    one = salted_join(pairs.withColumnRenamed("b", "node"), candidates, "node").select("a", F.col("node").alias("b"), F.col("text").alias("text_b"))
    return salted_join(one, candidates.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a", counted=pairs).sortWithinPartitions("b")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """One document of each class: the one of the smallest doc_id, with the columns of ``docs``."""
    kept = classes(docs, **how).where("keeper").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.col("text_key").alias("_text_key"))
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.md5(F.coalesce("text", F.lit(""))).alias("_text_key"))
    keys = ["_id", "_text_key"]
    return row.join(kept, keys, "left_semi").dropDuplicates(keys).select("row.*")
