import random
from collections import deque

from pyspark.sql import functions as F

from planloom.operators import topology as T

EDGES = "id long, a long, b long, length double"


def plain(edges, source, terminals):
    """Paths of a breadth-first search that takes the smallest neighbour one hop nearer, read back from each terminal."""
    near, length = {}, {}
    for i, a, b, d in sorted(edges):
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
            length.setdefault(frozenset((a, b)), d)
    hop, queue = {source: 0}, deque([source])
    while queue:
        n = queue.popleft()
        for m in near.get(n, ()):
            if m not in hop:
                hop[m] = hop[n] + 1
                queue.append(m)
    out = {}
    for t in terminals:
        if t in hop:
            path = [t]
            while path[-1] != source:
                path.append(min(m for m in near[path[-1]] if hop.get(m) == hop[path[-1]] - 1))
            out[source, t] = (path[::-1], round(sum(length[frozenset(p)] for p in zip(path, path[1:])), 6))
    return out


def test_paths_of_any_length_equal_a_plain_search(spark):
    rng = random.Random(4)
    edges = [(k, k, k + 1, rng.random()) for k in range(55)]  # a run of 55 hops
    edges += [(200 + k, 100 + rng.randrange(30), 100 + rng.randrange(30), rng.random()) for k in range(45)]  # loops and parallel edges
    edges += [(300, 20, 110, 1.0), (301, 110, 20, 2.0), (302, 500, 501, 1.0)]
    sources, terminals = [0, 105, 500, 999], [55, 48, 3, 120, 121, 500, 777]
    df = spark.createDataFrame(edges, EDGES)
    node = lambda ids: spark.createDataFrame([(i, "S" if i % 2 else "T") for i in ids], "node long, system string")
    got = {(r.source, r.terminal): (r.path, round(r.total_length, 6)) for r in T.system_paths(df, node(sources + [0]), node(terminals)).collect()}
    want = {}
    for s in sources:
        want |= plain(edges, s, terminals)
    assert got == want and max(len(p) for p, _ in got.values()) > 50
    odd = T.system_paths(df, node(sources), node(terminals), system="S")
    assert {(r.source, r.terminal) for r in odd.collect()} == {k for k in want if k[0] % 2 and k[1] % 2}
    assert {(r.source, r.terminal) for r in T.system_paths(df, node(sources), node(terminals), max_hops=3).collect()} == {k for k, (p, _) in want.items() if len(p) <= 4}
    assert T.system_paths(df.limit(0), node(sources), node([5])).count() == 0
    feeds = T.feeds_edges(T.system_paths(df, node([0]), node([55]))).first()
    assert (feeds.from_id, feeds.to_id, feeds.n_nodes) == (0, 55, 56)
    assert T.system_paths(df, node([500]), node([500])).select(F.size("path")).first()[0] == 1


def test_trees_are_not_searched_from_every_source(spark, monkeypatch):
    """Sources that hang on a ring are searched from its nodes, in a forest nothing is searched, and paths are as in a plain search."""
    rng = random.Random(11)
    pairs = [(k, (k + 1) % 6) for k in range(6)] + [(2, 5)]  # a ring with a chord
    pairs += [(k, rng.randrange(k)) for k in range(6, 90)]  # trees that hang on it
    pairs += [(200 + k, 200 + (k - 1) // 3) for k in range(1, 60)] + [(300, 301), (310, 311), (311, 312)]  # trees of their own
    edges = [(i, a, b, rng.random()) for i, (a, b) in enumerate(rng.sample(pairs, len(pairs)))]
    sources = [*range(10, 50), 3, *range(215, 245), 200, 300, 301, 311, 999]
    terminals = [*range(30, 90), 0, 5, *range(205, 250), 301, 310, 312, 999]
    searched, search = [], T.search_trees

    def recorded(arcs, seeds, *rest):
        searched.append((seeds.count(), arcs.df.select("src").distinct().count()))
        return search(arcs, seeds, *rest)

    monkeypatch.setattr(T, "search_trees", recorded)
    monkeypatch.setattr(T, "PAIR_BLOCK", 7, raising=False)
    df = spark.createDataFrame(edges, EDGES)
    node = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
    found = T.system_paths(df, node(sources), node(terminals)).collect()
    want = {}
    for s in sources:
        want |= plain(edges, s, terminals)
    assert {(r.source, r.terminal): (r.path, round(r.total_length, 6)) for r in found} == want and len(found) == len(want)
    assert all(r.hop == len(r.path) - 1 for r in found)
    assert len(searched) == 1 and searched[0][0] <= 6 and searched[0][1] == 6
    forest = T.system_paths(df.where("a >= 200"), node(sources), node(terminals)).collect()
    assert len(searched) == 1 and {(r.source, r.terminal) for r in forest} == {k for k in want if k[0] >= 200} | {(s, s) for s in sources if s < 200 and s in terminals}


def test_components_of_hubs_chains_and_lone_nodes(spark):
    rng = random.Random(9)
    edges = [(0, k) for k in range(1000, 1300)]  # a hub with most edges
    edges += [(k + 1, k) for k in range(2000, 2120)] + [(5, 5), (7, 6), (6, 7)]
    edges += [(3000 + rng.randrange(80), 3000 + rng.randrange(80)) for _ in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(k,) for k in (5, 9, 2000, 3000)], "node long")
    log = []
    got = {r.node: r.component for r in T.components(nodes, spark.createDataFrame(edges, "a long, b long").repartition(4), log=log).collect()}
    assert got == {x: find(x) for x in [*root, 9, 3000]}
    assert len(log) <= 9 and all(x["edges"] >= y["edges"] for x, y in zip(log, log[1:]))
    none = T.components(nodes.limit(0), spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0


def test_large_levels_are_not_broadcast(spark):
    """A level of 200,000 nodes is a few hundred kilobytes in files, so Spark would send it whole to the driver every round."""
    from pyspark.sql import functions as F

    from planloom.operators import graph
    from planloom.staging import materialize
    arcs = graph.Arcs(graph.adjacency(spark.range(1000).selectExpr("id a", "id + 1 b")))
    front = materialize(spark.range(200_000).select(F.lit(1).alias("seed"), (F.col("id") * 7919).alias("src")))
    assert "BroadcastHashJoin" not in arcs.step(front)._jdf.queryExecution().executedPlan().toString()
