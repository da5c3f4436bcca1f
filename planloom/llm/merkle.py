"""Operator 11, a Merkle manifest of a dataset by checkpoint-and-recompute.

Rows are leaves of one tree for each group (language), in the order of their ids; the roots of the groups, in order, are the
leaves of the tree above, whose root stands for the dataset. A node is the hash of ``fan`` consecutive nodes of the level
below (the last one of fewer, even of one).

Only every ``levels``-th level is written: the nodes of an aligned subtree of fan**levels stored nodes meet in one task, which
builds the levels between and hands on the subtree's top. Proofs are read from the top down: a task gets the stored nodes of
one aligned subtree and the path of its top, regenerates the nodes between, hands on the siblings of each stored node and
forgets the rest. So a level of the tree is never in one place, and what a task holds has a fixed bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from planloom.llm.common import numbered, partitions, salted_join
from planloom.staging import Stage

#: Children of a node, and levels of the tree from one that is written to the next: subtrees of 2**8 nodes.
FAN, LEVELS = 2, 8
#: Nodes whose paths are handed on at a time.
HANDED = 4096
#: The siblings of a node on each level up to the root: those on its left and those on its right, one after the other.
PATH = "array<struct<left:string,right:string>>"
NODE = ["tree", "pos", "digest", "n"]


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def combine(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def grown(nodes: list[str], fan: int, levels: int) -> list[list[str]]:
    """The levels of one aligned subtree from its stored nodes up."""
    out = [nodes]
    for _ in range(levels):
        nodes = [combine(nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        out.append(nodes)
    return out


def height(n: Column, fan: int, levels: int) -> Column:
    """Levels from ``n`` nodes to one, ``levels`` at most: a tree that has come to one node does not grow on."""
    return sum((F.when(n > fan**k, 1).otherwise(0) for k in range(levels)), F.lit(0)).cast("int")


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows with equal (tree, part), which follow each other."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["part"]) != current:
                if rows:
                    yield rows
                current, rows = (row["tree"], row["part"]), []
            rows.append(row)
    if rows:
        yield rows


def dealt(nodes: DataFrame) -> DataFrame:
    """Aligned subtrees as runs of rows; the row of a subtree's own path (pos -1) comes first."""
    return nodes.repartition(partitions(nodes.sparkSession), "tree", "part").sortWithinPartitions("tree", "part", "pos")


def tops(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """(tree, pos, digest, n) one written level higher than ``nodes`` (tree, pos, digest, n), n nodes of the tree's level."""
    schema = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])
    size = fan**levels

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for rows in runs(batches):
            first = rows[0]
            digest = grown([r["digest"] for r in rows], fan, first["up"])[-1][0]
            out.append({"tree": first["tree"], "pos": first["part"], "digest": digest, "n": -(-first["n"] // size)})
            if len(out) >= HANDED:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    parts = nodes.select("tree", F.floor(F.col("pos") / size).alias("part"), "pos", "digest", "n", height(F.col("n"), fan, levels).alias("up"))
    return dealt(parts).mapInArrow(build, "tree long, pos long, digest string, n long")


def siblings(nodes: DataFrame, above: DataFrame, fan: int, levels: int) -> DataFrame:
    """``nodes`` (tree, pos, digest, more columns; n is left out) with ``path`` and ``top``.

    ``above`` (tree, pos, path, top) has those of the top of each aligned subtree; the path of a node is that of its
    subtree's top after the node's own siblings on the levels below, ``top`` is handed down as it is."""
    more = [c for c in nodes.columns if c not in NODE]
    kept = nodes.select("tree", "pos", "digest", *more).schema
    kinds = to_arrow_schema(kept)
    struct = pa.struct([("left", pa.string()), ("right", pa.string())])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tops, lefts, rights, ends = [], [], [], [], [0]

        def packed():
            both = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], fields=list(struct))
            own = [pa.array([row[f.name] for row in held], f.type) for f in kinds]
            columns = [*own, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both), pa.array(tops, pa.string())]
            out = pa.RecordBatch.from_arrays(columns, names=[*kinds.names, "path", "top"])
            for column in (held, tops, lefts, rights):
                column.clear()
            ends[:] = [0]
            return out

        for head, *rows in runs(batches):
            above_left, above_right = [at["left"] for at in head["path"]], [at["right"] for at in head["path"]]
            between = grown([row["digest"] for row in rows], fan, rows[0]["up"])
            for at, row in enumerate(rows):
                for level in between[:-1]:
                    run = at - at % fan
                    lefts.append("".join(level[run:at]))
                    rights.append("".join(level[at + 1 : run + fan]))
                    at //= fan
                lefts += above_left
                rights += above_right
                ends.append(len(lefts))
                held.append(row)
                tops.append(head["top"])
                if len(held) >= HANDED:
                    yield packed()
        if held:
            yield packed()

    null = lambda kind: F.lit(None).cast(kind)
    parts = nodes.select("tree", F.floor(F.col("pos") / fan**levels).alias("part"), "pos", "digest", height(F.col("n"), fan, levels).alias("up"),
                         null(PATH).alias("path"), null("string").alias("top"), *more)
    heads = above.select("tree", F.col("pos").alias("part"), F.lit(-1).cast("long").alias("pos"), null("string").alias("digest"), F.lit(0).alias("up"), "path", "top",
                         *(null(f.dataType).alias(f.name) for f in kept if f.name in more))
    nullable = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return dealt(parts.unionByName(heads)).mapInArrow(build, f"{nullable}, path {PATH}, top string")


def written_levels(nodes: DataFrame, stage: Stage, fan: int, levels: int) -> list[DataFrame]:
    """The written levels of all trees from ``nodes`` up; the last one has one node for each tree."""
    out, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(stage.write(tops(out[-1].select(NODE), fan, levels)))
        most = -(-most // fan**levels)
    return out


def paths_down(written: list[DataFrame], above: DataFrame, stage: Stage, fan: int, levels: int) -> DataFrame:
    """The lowest of the ``written`` levels with ``path`` and ``top``; ``above`` (tree, path, top) has those of the trees' roots."""
    if len(written) == 1:
        return written[0].drop("n").join(above, "tree")
    above = above.withColumn("pos", F.lit(0).cast("long"))
    for nodes in written[-2:0:-1]:
        above = stage.write(siblings(nodes, above, fan, levels).select("tree", "pos", "path", "top"))
    return siblings(written[0], above, fan, levels)


def folded(digest: Column, path: Column) -> Column:
    """The root that a digest and its path lead to."""
    return F.aggregate(path, digest, lambda node, at: F.sha2(F.concat(at["left"], node, at["right"]), 256))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""), 256)


def proofs(leaves: DataFrame, group: str, order: str, digest: str = "leaf", fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``leaves`` with ``path`` (the leaf's siblings level by level up to the root: those on its left, those on its right),
    ``subroot`` (the root of its group) and ``root``.

    ``digest`` is a leaf's hash (64 hexadecimal digits). Groups are ordered by name, null first, which is a group like any
    other. The leaves of a group are ordered by ``order``, null first, and equal ones by their hash; leaves equal in all that
    have equal hashes, so it makes no difference which comes first: repeated rows are leaves of their own. A group of one leaf
    has that leaf for its root, and so has the whole if there is one group. An empty table has no rows. Other columns are
    handed on, whatever their names.
    """
    stage = Stage(leaves.sparkSession, "merkle")
    own = F.struct(*(F.col(f"`{c}`") for c in leaves.columns)).alias("own")
    name = F.coalesce(F.concat(F.lit("+"), F.col(group)), F.lit("")).alias("name")  # ordered as the group is, null first
    rows = stage.write(leaves.select(name, F.col(order).alias("key"), F.col(digest).alias("digest"), own))
    sizes = rows.groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    trees = stage.write(numbered(sizes, [F.asc("name")], stage, F.col("n")).withColumnRenamed("base", "tree"))  # the place of its first leaf
    placed = stage.write(numbered(rows, [F.asc("name"), F.asc_nulls_first("key"), F.asc("digest")], stage))
    placed = stage.write(salted_join(placed, trees, "name").select("tree", (F.col("base") - F.col("tree")).alias("pos"), "digest", "n", "own"))
    written = written_levels(placed, stage, fan, levels)
    subroots = stage.write(numbered(written[-1].select(F.col("tree").alias("of"), "digest"), [F.asc("of")], stage))
    n_trees = subroots.count()
    zero = F.lit(0).cast("long")
    forest = written_levels(subroots.select(zero.alias("tree"), F.col("base").alias("pos"), "digest", F.lit(n_trees).cast("long").alias("n"), "of"), stage, fan, levels)
    whole = forest[-1].select("tree", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    above = paths_down(forest, whole, stage, fan, levels).select(F.col("of").alias("tree"), "path", F.col("digest").alias("top"), F.col("top").alias("root"))
    above = stage.write(above)
    root = above.agg(F.max("root")).first()[0]  # the same in every row
    out = paths_down(written, above.drop("root"), stage, fan, levels)
    return out.select("own.*", F.col("path").alias("path"), F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"))


def verified(docs: DataFrame, tampered: Column, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents (doc_id, source, lang, n_chars, text).

    The manifest and its proofs are made of the rows as they are. Then each row is checked against its proof; where
    ``tampered`` (a condition on doc_id) is true, the row to check has one more in n_chars. Nulls in any column are part of
    the hash: a null n_chars can't be tampered with. Texts are read once, whole, and only their hashes move.
    """
    cast = lambda c, kind: F.col(c).cast(kind).alias(c)
    rows = docs.select(cast("doc_id", "long"), cast("source", "string"), cast("lang", "string"), cast("n_chars", "decimal(20,0)"), cast("text", "string"))
    of = lambda n_chars: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    checked = F.when(tampered, of((F.col("n_chars") + 1).cast("decimal(20,0)")))
    leaves = rows.select("doc_id", "lang", of(F.col("n_chars")).alias("leaf"), checked.alias("changed"))
    out = proofs(leaves, "lang", "doc_id", fan=fan, levels=levels)
    out = out.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
