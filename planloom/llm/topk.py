"""Operator 5, exact top-k inner products over vectors in descending length.

Components are integers, floor(scale * x). Vectors are numbered by descending length and cut into blocks; the stated queries
are cut into blocks as well. The block of the longest vectors gives every query a first k-th score. Pairs of blocks whose
lengths cannot reach it (Cauchy-Schwarz) are left out; in the others partial sums over the leading axes of an SVD rotation,
plus the product of the residual lengths, rule out vectors before exact products decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import numbered
from planloom.staging import Stage

#: Components of a block of vectors and of a block of queries.
BLOCK, QUERY_BLOCK = 1 << 19, 1 << 17
#: Part of the rotated axes that the bound uses, and part of survivors beyond which a whole matrix product is cheaper.
LEADING, DENSE = 0.25, 0.1
#: Scores of one matrix that are held at a time.
SCORES = 1 << 21
EXACT = float(1 << 53)


def integers(df: DataFrame, vec_id: str, embedding: str, scale: int) -> DataFrame:
    """(vec_id, v): scaled components. Vectors that are null or have a null, non-finite or immense (beyond 2**53 when scaled)
    component, and rows without an id, take no part; an id that repeats keeps its smallest vector."""
    x = F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * scale))
    fine = F.forall(F.col(embedding), lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) * scale < EXACT))
    return df.where(F.col(embedding).isNotNull() & fine & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def rotation(vectors: DataFrame, d: int) -> np.ndarray:
    """Axes of the vectors by descending weight: the right singular vectors, from a d x d sum over all vectors."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((d, d))
        for batch in batches:
            m = matrix(batch.column("v"), d).astype(float)
            g += m.T @ m
        i, j = np.nonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(g[i, j])], names=["i", "j", "g"])

    out = np.zeros((d, d))
    for r in vectors.select("v").mapInArrow(gram, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g")).collect():  # d * d rows at most
        out[r["i"], r["j"]] = r["g"]
    return np.linalg.eigh(out)[1][:, ::-1]


def matrix(lists: pa.Array, d: int) -> np.ndarray:
    """Rows of the lists, shorter ones filled up with 0."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), d), np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def best_of(q_ids, q, c_ids, c, least, axes, k):
    """For each query (position in q, ids, scores) of its up to ``k`` best vectors that reach its ``least`` score."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]  # equal scores: smaller id first
    n, w = len(c), max(1, int(len(axes) * LEADING))
    qf, cf = q.astype(float), c.astype(float)
    small = (np.sqrt((qf**2).sum(1)).max(initial=0) * np.sqrt((cf**2).sum(1)).max(initial=0)) * (n + 1) < EXACT
    qr, cr = qf @ axes, cf @ axes
    q_rest, c_rest = np.sqrt((qr[:, w:] ** 2).sum(1)), np.sqrt((cr[:, w:] ** 2).sum(1))
    c_long = np.sqrt((cf**2).sum(1))
    for lo in range(0, len(q), max(1, SCORES // max(1, n))):
        own = slice(lo, lo + max(1, SCORES // max(1, n)))
        bound = least[own].astype(float)
        slack = 1e-9 * np.sqrt((qf[own] ** 2).sum(1))[:, None] * c_long[None, :] + 1e-6
        may = qr[own, :w] @ cr[:, :w].T + q_rest[own, None] * c_rest[None, :] + slack >= bound[:, None]
        may &= q_ids[own, None] != c_ids[None, :]
        if may.mean() > DENSE and small:
            scores = (qf[own] @ cf.T).astype(np.int64)
            may &= scores >= least[own, None]
            key = np.where(may, scores * (n + 1) + (n - np.arange(n)), -(1 << 62))
            top = np.argpartition(-key, min(k, n) - 1, axis=1)[:, :k] if n > k else np.tile(np.arange(n), (len(key), 1))
            rows = np.arange(len(key))[:, None]
            for i, (kept, at) in enumerate(zip(may[rows, top], top)):
                if kept.any():
                    yield lo + i, c_ids[at[kept]], scores[i, at[kept]]
        else:
            for i in np.flatnonzero(may.any(axis=1)):
                at = np.flatnonzero(may[i])
                scores = (c[at] * q[lo + i]).sum(axis=1)
                at, scores = at[scores >= least[lo + i]], scores[scores >= least[lo + i]]
                if len(at):
                    first = np.lexsort((at, -scores))[:k]
                    yield lo + i, c_ids[at[first]], scores[first]


def score_pairs(pairs: DataFrame, axes: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best of every pair of blocks (queries: query_id, v, least; rows: vec_id, v)."""
    d = len(axes)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qs, cs = batch.column("queries")[r].values, batch.column("rows")[r].values
                q_ids, c_ids = qs.field("vec_id").to_numpy(), cs.field("vec_id").to_numpy()
                found = list(best_of(q_ids, matrix(qs.field("v"), d), c_ids, matrix(cs.field("v"), d), qs.field("least").to_numpy(), axes, k))
                ids = np.repeat(q_ids[[f[0] for f in found]], [len(f[1]) for f in found]) if found else np.zeros(0, np.int64)
                columns = [ids, *(np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["query_id", "vec_id", "score"])

    return pairs.select("queries", "rows").mapInArrow(score, "query_id long, vec_id long, score long")


def best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for every row for which ``is_query`` (of vec_id) holds, the ``k`` largest inner
    products with other rows, or all if there are fewer; equal scores go to the smaller vec_id.

    See ``integers`` for the rows that take no part. Vectors of unlike length are compared as if filled up with zeros.
    """
    stage = Stage(df.sparkSession, "topk")
    vectors = stage.write(integers(df, vec_id, embedding, scale))
    d = vectors.agg(F.max(F.size("v"))).first()[0]
    d = d or 1  # no vector, or only empty ones
    axes = rotation(vectors, d)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ranked = numbered(vectors.withColumn("length", length), [F.desc("length"), "vec_id"], stage)
    ranked = stage.write(ranked.withColumn("block", F.floor(F.col("base") / max(64, BLOCK // d)).cast("long")))
    rows = ranked.groupBy("block").agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"), F.max("length").alias("longest"))
    queries = stage.write(numbered(ranked.where(is_query).select("vec_id", "v", "length"), [F.desc("length"), "vec_id"], stage).withColumn("group", F.floor(F.col("base") / max(64, QUERY_BLOCK // d)).cast("long")).drop("base"))

    def grouped(least: Column) -> Column:
        return F.collect_list(F.struct("vec_id", "v", least.alias("least"))).alias("queries")

    lowest = F.lit(-(1 << 62)).cast("long")
    head = rows.where("block = 0").select("block", "rows")
    first = queries.groupBy("group").agg(grouped(lowest)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(0).cast("long"))).alias("block")).join(head, "block")
    first = stage.write(best(score_pairs(first.repartition("group"), axes, k), k).drop("rank"))
    least = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth")).withColumnRenamed("query_id", "vec_id")
    asked = queries.join(least, "vec_id", "left").withColumn("least", F.coalesce("kth", lowest))
    groups = stage.write(asked.groupBy("group").agg(grouped(F.col("least")), F.max("length").alias("q_longest"), F.min("least").alias("weakest")))
    last = ranked.agg(F.max("block")).first()[0] or 0
    blocks = stage.write(rows.where("block > 0"))
    # which pairs of blocks may matter is decided on their lengths, before any vector moves
    numbers = F.sequence(F.lit(0), F.lit(last))
    pairs = groups.select("group", "q_longest", "weakest", F.explode(numbers).alias("block"))
    pairs = pairs.withColumn("block", F.col("block").cast("long")).join(blocks.select("block", "longest"), "block").where(F.col("q_longest") * F.col("longest") * (1 + 1e-9) + 1e-6 >= F.col("weakest").cast("double"))
    loaded = pairs.select("group", "block").join(blocks.select("block", "rows"), "block").join(groups.select("group", "queries"), "group")
    rest = score_pairs(loaded.repartition("group", "block"), axes, k)
    return best(first.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
