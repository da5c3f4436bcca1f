"""Registered queries: vector, hybrid and fact search, ranked lists."""

from pyspark.sql import functions as F

from planloom.operators import filters as X
from planloom.operators import keyed as K
from planloom.operators import relations as R
from planloom.operators import vector as V
from planloom.plans.bind import ctes
from planloom.plans.registry import query

COS = "(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]))"
VQ = "v AS (SELECT vec_id AS id, embedding, label FROM embeddings), q AS (SELECT * FROM v WHERE id=(SELECT min(id) FROM v))"


def vectors(t):
    return t.embeddings.withColumnRenamed("vec_id", "id")


def first_vector(t):
    return vectors(t).orderBy("id").limit(1).select(F.col("embedding").alias("qvec"))


@query("vector_topk", "K1", f"WITH {VQ} SELECT v.id, v.label, {COS} AS distance FROM v, q WHERE v.label IN (0,1,2,3,4) ORDER BY distance, v.id LIMIT 10")
def _(t):
    return V.vector_topk(vectors(t), first_vector(t), 10, F.col("label").isin(0, 1, 2, 3, 4)).select("id", "label", "distance")


EV = f"""v AS (SELECT e.*, b.embedding FROM elements e JOIN embeddings b ON b.vec_id=e.id WHERE NOT deleted), q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"""


def element_vectors(t):
    return t.elements.where("not deleted").join(vectors(t).select("id", "embedding"), "id")


@query("hybrid_topk", "K2", ctes("elements") + f""", {EV}
SELECT v.id, {COS} AS distance, sqrt((x-50)*(x-50)+(y-50)*(y-50)+(z-2)*(z-2)) AS spatial_distance FROM v, q
 WHERE sqrt((x-50)*(x-50)+(y-50)*(y-50)+(z-2)*(z-2))<=30 ORDER BY distance, v.id LIMIT 10""")
def _(t):
    return V.hybrid_topk(element_vectors(t), first_vector(t), (50.0, 50.0, 2.0), 30.0, 10).select("id", "distance", "spatial_distance")


@query("hybrid_topk_near", "K2", ctes("elements") + f""", {EV}, spot AS (SELECT x AS px, y AS py, z AS pz FROM v ORDER BY id LIMIT 1)
SELECT v.id, {COS} AS distance, sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz)) AS spatial_distance FROM v, q, spot
 WHERE sqrt((x-px)*(x-px)+(y-py)*(y-py)+(z-pz)*(z-pz))<=30 ORDER BY distance, v.id LIMIT 10""")
def _(t):
    """The same around the element of the smallest id."""
    e = element_vectors(t)
    return V.hybrid_topk_near(e, first_vector(t), e.agg(F.min("id")).first()[0], 30.0, 10).select("id", "distance", "spatial_distance")


@query("symbol_topk", "K3", f"WITH {VQ} SELECT v.id, 1-{COS} AS confidence FROM v, q WHERE {COS}<1-0.05 ORDER BY {COS}, v.id LIMIT 20")
def _(t):
    return V.symbol_topk(vectors(t), first_vector(t), 20, 0.05).select("id", "confidence")


@query("vector_join", "K4", """WITH q AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM
 (SELECT label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT qid, id, distance, rn FROM (SELECT q.label AS qid, v.vec_id AS id, 1-list_cosine_similarity(v.embedding::DOUBLE[], q.c) AS distance,
 row_number() OVER (PARTITION BY q.label ORDER BY 1-list_cosine_similarity(v.embedding::DOUBLE[], q.c), v.vec_id) AS rn FROM q, embeddings v) WHERE rn<=5""")
def _(t):
    """The five library vectors nearest to the mean vector of every label."""
    parts = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    queries = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("qvec"))
    return V.vector_join(queries.withColumnRenamed("label", "qid"), vectors(t), 5)


@query("facts_search", "K5", ctes("facts") + """, v AS (SELECT f.id, b.embedding FROM facts f JOIN embeddings b ON b.vec_id=f.id WHERE expires_at IS NULL OR expires_at>TIMESTAMP '2024-01-03'),
 q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT v.id, """ + COS + " AS distance FROM v, q ORDER BY distance, v.id LIMIT 5")
def _(t):
    live = K.live_facts(t.facts, F.lit("2024-01-03").cast("timestamp")).join(vectors(t).select("id", "embedding"), "id")
    return V.vector_topk(live, first_vector(t), 5).select("id", "distance")


@query("pending_suggestions", "K6", "SELECT o_orderkey AS id, o_orderpriority AS priority FROM orders WHERE o_orderstatus='O' ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey LIMIT 50")
def _(t):
    return t.orders.where("o_orderstatus = 'O'").orderBy("o_orderpriority", F.desc("o_orderdate"), "o_orderkey").limit(50).select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"))


@query("prefer_nearby", "K7", ctes("elements") + f""", {EV}, c AS (SELECT v.id, row_number() OVER (ORDER BY {COS}, v.id) AS rank FROM v, q ORDER BY rank LIMIT 5),
r AS (SELECT * FROM elements WHERE id=(SELECT min(id) FROM elements WHERE NOT deleted)), n AS (SELECT e.id FROM elements e, r WHERE NOT e.deleted AND e.project_id=r.project_id AND e.id<>r.id
 AND sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z))<=60 ORDER BY sqrt((e.x-r.x)*(e.x-r.x)+(e.y-r.y)*(e.y-r.y)+(e.z-r.z)*(e.z-r.z)), e.id LIMIT 50)
SELECT id, rank FROM c ORDER BY id IN (SELECT id FROM n) DESC, rank LIMIT 1""")
def _(t):
    from pyspark.sql import Window as W
    top = V.vector_topk(element_vectors(t), first_vector(t), 5).select("id", "distance")
    cands = top.withColumn("rank", F.row_number().over(W.orderBy("distance", "id")).cast("long"))  # five rows
    live = t.elements.where("not deleted")
    near = R.nearby(live, live.orderBy("id").limit(1), 60.0).orderBy("distance", "id").limit(50)
    return V.prefer_nearby(cands, near.select("id")).select("id", "rank")


@query("recent", "W6", ctes("facts") + " SELECT project_id, id, rn FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, id) rn FROM facts) WHERE rn<=5")
def _(t):
    return X.recent(t.facts, ["project_id"], "created_at", 5, "id").select("project_id", "id", "rn")
