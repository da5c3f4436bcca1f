"""Vector search: exact top-k by cosine distance, filtered, hybrid and in batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.operators.relations import XYZ
from planloom.ordered import first_n

MAX_QUERIES = 4096


def dot(a: Column, b: Column) -> Column:
    z = F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double"))
    return F.aggregate(z, F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 for a vector of zeros, which has no direction."""
    return 1.0 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def vector_topk(df: DataFrame, query: DataFrame, k: int, where: Column | None = None, vec: str = "embedding",
                tie: str = "id", max_distance: float | None = None) -> DataFrame:
    """k nearest rows to one query vector (``query``: one row with column ``qvec``).

    The query row is read once and becomes a literal, so the scan computes the distance in one pass and every
    task keeps k rows.
    """
    q = query.select("qvec").first()
    if q is None:
        return df.withColumn("distance", F.lit(None).cast("double")).limit(0)
    return _scored(df, q["qvec"], where, vec, max_distance).orderBy("distance", tie).limit(k)


def _scored(df: DataFrame, q: list[float], where: Column | None, vec: str, max_distance: float | None) -> DataFrame:
    if where is not None:
        df = df.where(where)
    norm = float(np.sqrt(np.dot(q, q)))
    lit = F.array(*[F.lit(float(v)) for v in q])
    d = 1.0 - F.coalesce(F.try_divide(dot(F.col(vec), lit), F.sqrt(dot(F.col(vec), F.col(vec))) * norm), F.lit(0.0))
    out = df.where(F.col(vec).isNotNull()).withColumn("distance", d)
    return out.where(F.col("distance") < max_distance) if max_distance is not None else out


def symbol_topk(df: DataFrame, query: DataFrame, k: int, min_confidence: float, where: Column | None = None,
                vec: str = "embedding", tie: str = "id") -> DataFrame:
    """Top-k with confidence = 1 - distance above a threshold."""
    return vector_topk(df, query, k, where, vec, tie, 1.0 - min_confidence).withColumn(
        "confidence", 1.0 - F.col("distance"))


def hybrid_topk(df: DataFrame, query: DataFrame, point: tuple[float, ...], radius: float, k: int,
                vec: str = "embedding", tie: str = "id") -> DataFrame:
    """Rows inside a radius ranked by cosine distance; both distances returned."""
    pos = XYZ[: len(point)]
    d2 = sum(((F.col(p) - v) * (F.col(p) - v) for p, v in zip(pos, point)), F.lit(0.0))
    near = df
    for p, v in zip(pos, point):
        near = near.where(F.col(p).between(v - radius, v + radius))
    near = near.withColumn("spatial_distance", F.sqrt(d2)).where(F.col("spatial_distance") <= radius)
    return vector_topk(near, query, k, None, vec, tie)


def hybrid_topk_near(df: DataFrame, query: DataFrame, element, radius: float, k: int, vec: str = "embedding", tie: str = "id") -> DataFrame:
    """``hybrid_topk`` around the element with the id ``element``, which counts itself. Without it (or its place) no rows."""
    at = df.where((F.col(tie) == element) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).select(*XYZ).first()
    return hybrid_topk(df if at else df.limit(0), query, tuple(at) if at else (0.0, 0.0, 0.0), radius, k, vec, tie)


def prefer_nearby(candidates: DataFrame, nearby_ids: DataFrame) -> DataFrame:
    """First candidate (by rank) that is near the context element, else the top one."""
    near = nearby_ids.select("id", F.lit(True).alias("_n"))
    return candidates.join(near, "id", "left").withColumn("is_near", F.coalesce("_n", F.lit(False))).drop("_n").orderBy(
        F.desc("is_near"), "rank").limit(1)


def vector_join(queries: DataFrame, library: DataFrame, k: int, qid: str = "qid", qvec: str = "qvec",
                id: str = "id", vec: str = "embedding", exclude_same: bool = False,
                max_queries: int = MAX_QUERIES, block_rows: int = 65536) -> DataFrame:
    """Exact k best library rows for every query row.

    Vectors meet in matrix products of bounded size and only k rows per query leave each product, so no pair
    table is built. Up to ``max_queries`` queries (the size is checked) travel to the library scan as one
    broadcast matrix and the library is not shuffled. More queries are cut into blocks, as is the library, and
    each pair of blocks is one group of bounded size.
    """
    q = queries.select(F.col(qid).alias("q"), F.col(qvec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    lib = library.select(F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    schema = f"q {q.schema['q'].dataType.simpleString()}, id {lib.schema['id'].dataType.simpleString()}, distance double"
    if q.limit(max_queries + 1).count() <= max_queries:
        scored = _against_broadcast(q, lib, k, exclude_same, schema)
    else:
        scored = _by_blocks(q, lib, k, exclude_same, schema, max_queries, block_rows)
    return first_n(scored, ["q"], [F.col("distance"), F.col("id")], k).withColumnRenamed("q", qid)


def _unit(values) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=float) for v in values])
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(n == 0, 1.0, n)


def _best(qids: np.ndarray, qm: np.ndarray, ids: np.ndarray, lm: np.ndarray, k: int, exclude_same: bool) -> dict:
    dist = 1.0 - qm @ lm.T
    if exclude_same:
        dist = np.where(qids[:, None] == ids[None, :], np.inf, dist)
    order = np.lexsort((np.broadcast_to(ids, dist.shape), dist), axis=1)[:, :k]
    d = np.take_along_axis(dist, order, axis=1).ravel()
    ok = np.isfinite(d)
    return {"q": np.repeat(qids, order.shape[1])[ok], "id": ids[order].ravel()[ok], "distance": d[ok]}


def _against_broadcast(q: DataFrame, lib: DataFrame, k: int, exclude_same: bool, schema: str) -> DataFrame:
    rows = q.toPandas()
    if rows.empty:
        return q.sparkSession.createDataFrame([], schema)
    sent = q.sparkSession.sparkContext.broadcast((rows["q"].to_numpy(), _unit(rows["v"])))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qm = sent.value
        for batch in batches:
            if len(batch):
                yield pd.DataFrame(_best(qids, qm, batch["id"].to_numpy(), _unit(batch["v"]), k, exclude_same))

    return lib.mapInPandas(score, schema)


def _by_blocks(q: DataFrame, lib: DataFrame, k: int, exclude_same: bool, schema: str, max_queries: int,
               block_rows: int) -> DataFrame:
    qb = -(-q.count() // max_queries)
    lb = max(1, -(-lib.count() // block_rows))
    left = q.withColumn("qb", F.pmod(F.xxhash64("q"), F.lit(qb))).withColumn(
        "lb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lb - 1).cast("long"))))
    right = lib.withColumn("lb", F.pmod(F.xxhash64("id"), F.lit(lb))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(qb - 1).cast("long"))))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"q": a["q"][:0], "id": b["id"][:0], "distance": np.zeros(0)})
        return pd.DataFrame(_best(a["q"].to_numpy(), _unit(a["v"]), b["id"].to_numpy(), _unit(b["v"]), k, exclude_same))

    return left.groupBy("qb", "lb").cogroup(right.groupBy("qb", "lb")).applyInPandas(score, schema)
