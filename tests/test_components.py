import random

from planloom.operators import graph


def test_components_of_repeated_edges_loops_and_texts(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(7, 7), (299, 0), (0, 299), (0, 299), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None:
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    log = []
    none = spark.createDataFrame([], "node long")
    got = {r.node: r.component for r in graph.components(none, spark.createDataFrame(pairs, "a long, b long"), log=log).collect()}
    assert got == {x: find(x) for x in root}
    # the rounds begin with the different edges and end with one for each node that is not the smallest of its component
    assert log[0]["edges"] == len({(min(p), max(p)) for p in pairs if None not in p and p[0] != p[1]})
    assert log[-1]["edges"] == sum(x != c for x, c in got.items())
