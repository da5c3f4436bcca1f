"""Graph jobs over an edge table: breadth-first levels, paths and connected components.

Every loop joins a frontier with the arc table, writes the round and goes on; arcs of a hub node are spread
over several tasks because the hub list is fixed once per graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from planloom.skew import BROADCAST_BYTES, hot_keys, is_small, salted_join, shuffled
from planloom.staging import Stage


def adjacency(edges: DataFrame, a: str = "a", b: str = "b", keep: list[str] | None = None, system: str | None = None) -> DataFrame:
    """Both directions of every edge, of those of one ``system`` if given, as (src, dst, kept columns); one row per neighbour,
    never a list per node."""
    cols = keep or []
    if system is not None:
        edges = edges.where(F.col("system") == system)
    out = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"), *cols)
    return out.unionByName(edges.select(F.col(b).alias("src"), F.col(a).alias("dst"), *cols)).distinct()


class Arcs:
    def __init__(self, arcs: DataFrame, stage: Stage | None = None):
        self.stage = stage or Stage(arcs.sparkSession, "graph")
        self.df = self.stage.write(arcs)
        self.hot = hot_keys(self.df, ["src"])

    def step(self, frontier: DataFrame, condition: Column | None = None) -> DataFrame:
        """Frontier rows (column ``src``) joined with the arcs that leave them."""
        return salted_join(self.df, frontier, ["src"], condition, hot=self.hot, shuffle=not is_small(frontier, BROADCAST_BYTES))


def unless_small(df: DataFrame) -> DataFrame:
    """The written table ``df``, for a join that may broadcast it only if it is small: a search joins with one every round."""
    return df if is_small(df, BROADCAST_BYTES) else shuffled(df)


def levels(arcs: Arcs, seeds: DataFrame, depth: int | None, paths: bool = False, stop: DataFrame | None = None,
           expand: DataFrame | None = None) -> DataFrame:
    """Breadth-first levels from every seed: (seed, node, hop[, path]); the path is the smallest shortest one.

    ``expand`` optionally restricts the nodes that may be entered. Arcs go both ways, so a neighbour of the last level lies in
    the last two levels or is new, and only these two are looked up. Only small levels are broadcast.
    """
    stage = arcs.stage
    front = seeds.select("seed", "node", F.lit(0).alias("hop"), *([F.array("node").alias("path")] if paths else []))
    front = stage.write(front)
    seen, last = front, None
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        step = arcs.step(front.withColumnRenamed("node", "src").drop("hop")).withColumnRenamed("dst", "node")
        if paths:
            step = step.withColumn("path", F.concat("path", F.array("node")))
            step = step.groupBy("seed", "node").agg(F.min("path").alias("path"))
        else:
            step = step.select("seed", "node").distinct()
        if expand is not None:
            step = step.join(expand, "node", "left_semi")
        for known in (front, last):
            if known is not None:
                step = step.join(unless_small(known.select("seed", "node")), ["seed", "node"], "left_anti")
        last, front = front, stage.write(step.select("seed", "node", F.lit(hop).alias("hop"), *(["path"] if paths else [])))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def search_trees(arcs: Arcs, seeds: DataFrame, weight: str, depth: int | None = None) -> DataFrame:
    """Breadth-first trees (seed, node, hop, parent, total) of the ``seeds`` (seed, node), one row per seed and reached node.

    The parent is the smallest neighbour one hop nearer, null at the seed; ``total`` sums the arcs' ``weight`` on the way. A
    neighbour of the last level lies in the last two levels or is new, so only these two are looked up, however deep it goes.
    """
    path, write = arcs.stage.write_rounds("hop")
    parent = F.lit(None).cast(arcs.df.schema["src"].dataType)
    front = write(seeds.select("seed", "node", parent.alias("parent"), F.lit(0.0).alias("total")), 0)
    schema, last, hop = front.schema, None, 0
    while (depth is None or hop < depth) and not front.isEmpty():
        hop += 1
        step = arcs.step(front.select("seed", F.col("node").alias("src"), "total"))
        best = F.min(F.struct("src", (F.col("total") + F.col(weight)).alias("total")))
        step = step.groupBy("seed", F.col("dst").alias("node")).agg(best.alias("f"))
        for known in (front, last):
            if known is not None:
                step = step.join(unless_small(known.select("seed", "node")), ["seed", "node"], "left_anti")
        last, front = front, write(step.select("seed", "node", F.col("f.src").alias("parent"), F.col("f.total").alias("total")), hop)
    spark = arcs.df.sparkSession
    return spark.read.schema(schema.add("hop", IntegerType())).option("basePath", path).parquet(path)


def tree_paths(trees: DataFrame, ends: DataFrame, stage: Stage) -> DataFrame:
    """(seed, end, pos, node): the nodes of the path from each seed (pos 0) to each of ``ends`` (seed, node, hop) by pointer doubling.

    Jumps over 1, 2, 4, ... parents are tables of their own. From the longest jump down, every known place of a path gives the
    place that far ahead of it; each place is reached once, so the rows are the paths' nodes and the rounds their logarithm.
    """
    ends = stage.write(ends.select("seed", F.col("node").alias("end"), F.col("hop").alias("pos"), "node"))
    longest = ends.agg(F.max("pos")).first()[0] or 0
    jumps = []
    while 1 << len(jumps) <= longest:
        if not jumps:
            jump = trees.where("hop > 0").select("seed", "node", F.col("parent").alias("to"))
        else:
            ahead = jumps[-1].select("seed", F.col("node").alias("to"), F.col("to").alias("beyond"))
            jump = salted_join(jumps[-1], ahead, ["seed", "to"]).select("seed", "node", F.col("beyond").alias("to"))
        jumps.append(stage.write(jump))
    places = ends
    for k in reversed(range(len(jumps))):
        more = salted_join(places, jumps[k], ["seed", "node"]).select("seed", "end", (F.col("pos") - (1 << k)).alias("pos"), F.col("to").alias("node"))
        places = stage.write(places.unionByName(more))
    return places


def hanging_trees(arcs: Arcs, weight: str) -> tuple[DataFrame, DataFrame, int]:
    """The trees that hang off the graph, as (node, parent, ``weight``), the arcs of what they hang on, and a bound of their height.

    Nodes of one neighbour are taken off, round after round, until none is left. Of a tree that hangs on nothing one node
    stays, the smaller of the last two. Each round leaves fewer arcs; there are as many rounds as the highest tree has levels.
    """
    stage = arcs.stage
    path, write = stage.write_rounds("round")
    rest, last, height = arcs.df, None, 0
    while True:
        one = rest.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("dst"), F.first(weight).alias(weight)).where("n = 1")
        ends = one.groupBy(F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg(
            F.count(F.lit(1)).alias("n"), F.min("src").alias("src"), F.first(weight).alias(weight))
        node = F.when(F.col("n") == 2, F.col("hi")).otherwise(F.col("src"))
        off = write(ends.select(node.alias("node"), F.when(node == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("parent"), weight), height)
        if off.isEmpty():
            break
        height += 1
        gone, shuffle = off.select(F.col("node").alias("dst")), not is_small(off, BROADCAST_BYTES)
        rest = salted_join(rest, gone, ["dst"], how="left_anti", hot=arcs.hot, shuffle=shuffle)
        rest, new = stage.write_path(salted_join(rest, gone.withColumnRenamed("dst", "src"), ["src"], how="left_anti", hot=[], shuffle=shuffle))
        stage.drop(last)
        last = new
    trees = arcs.df.sparkSession.read.schema(off.schema.add("round", IntegerType())).option("basePath", path).parquet(path)
    return trees.drop("round"), rest, height


def climb(trees: DataFrame, ends: DataFrame, height: int, weight: str, stage: Stage) -> DataFrame:
    """(end, hop, node, total, branch): the nodes above each of ``ends`` (node) in its tree, itself at hop 0, by pointer doubling.

    ``trees``: (node, parent, ``weight``), at most ``height`` levels; ``total`` sums the weights on the way, ``branch`` is the
    node before on it, null for the end itself. The rounds are the height's logarithm, the rows the places of the ways.
    """
    jumps = []
    while 1 << len(jumps) <= height:
        if not jumps:
            jump = trees.select("node", F.col("parent").alias("to"), F.col(weight).alias("far"), F.col("node").alias("branch"))
        else:
            ahead = jumps[-1].select(F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("far").alias("more"), F.col("branch").alias("last"))
            jump = salted_join(jumps[-1].drop("branch"), ahead, ["to"]).select("node", F.col("beyond").alias("to"), (F.col("far") + F.col("more")).alias("far"), F.col("last").alias("branch"))
        jumps.append(stage.write(jump))
    null = F.lit(None).cast(trees.schema["node"].dataType)
    places = stage.write(ends.select(F.col("node").alias("end"), F.lit(0).alias("hop"), "node", F.lit(0.0).alias("total"), null.alias("branch")))
    for k in reversed(range(len(jumps))):
        more = salted_join(places.drop("branch"), jumps[k], ["node"]).select(
            "end", (F.col("hop") + (1 << k)).alias("hop"), F.col("to").alias("node"), (F.col("total") + F.col("far")).alias("total"), "branch")
        places = stage.write(places.unionByName(more))
    return places


def all_paths(arcs: Arcs, start, end, max_nodes: int) -> DataFrame:
    """Simple paths from ``start`` to ``end`` with at most ``max_nodes`` nodes (one row per path)."""
    spark = arcs.df.sparkSession
    stage = arcs.stage
    node_type = arcs.df.schema["src"].dataType
    front = spark.range(1).select(F.lit(start).cast(node_type).alias("src"),
                                  F.array(F.lit(start).cast(node_type)).alias("path"))
    found = front.where(F.lit(start == end)).select("path")
    for _ in range(max_nodes - 1):
        step = arcs.step(front).where(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("src"), F.concat("path", F.array("dst")).alias("path"))
        front = stage.write(step)
        if front.isEmpty():
            break
        found = found.unionByName(front.where(F.col("src") == F.lit(end)).select("path"))
        front = front.where(F.col("src") != F.lit(end))
    return found


def components(nodes: DataFrame, edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", log: list[dict] | None = None) -> DataFrame:
    """(node, component): component is the smallest node id. Isolated nodes are their own component.

    Large-star and small-star in turn: every node ties its larger neighbours to the smallest node around it, then its
    smaller neighbours and itself to the smallest of those. Edges point ever nearer to the smallest node and equal ones
    fall together, so only edges are kept, fewer each round, and a hub's edges meet its minimum in a salted join. It ends when
    the edges are stars: no smaller end has a smaller neighbour, and every larger end has one edge. The smallest node around an
    end is its smallest smaller neighbour, if there is one, so edges are grouped by their larger end alone.
    ``log`` gets the number of edges of every round.
    """
    stage = Stage(edges.sparkSession, "components")
    links = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    links, last = stage.write_path(links)
    while True:
        if log is not None:
            log.append({"edges": links.count()})
        least = links.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = salted_join(links, least, ["b"], how="left", hot=hot_keys(links, ["b"]))
        large, wide = stage.write_path(large.select("a", F.coalesce("m", "b").alias("b"), F.col("m").isNotNull().alias("moved")))
        if large.where("moved").isEmpty():
            row = links.agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("a").alias("ends")).first()
            if row["edges"] == row["ends"]:
                stage.drop(wide)
                break
        large = large.select("a", "b")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = salted_join(large, least, ["a"]).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        nxt, path = stage.write_path(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        for old in (last, wide):
            stage.drop(old)
        links, last = nxt, path
    ids = nodes.select(F.col(node).alias("node")).unionByName(edges.select(F.explode(F.array(a, b)).alias("node"))).where("node is not null").distinct()
    return ids.join(links.withColumnRenamed("a", "node").withColumnRenamed("b", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
