import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from planloom.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos int, `own` string"
def tampered():
    return F.crc32(F.col("doc_id").cast("string")) % 7 == 0


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows, fan=2):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) by whole levels in memory."""

    def leaf(doc_id, source, lang, n_chars, text):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + fan])) for k in range(0, len(out[-1]), fan)])
        return out

    def path(tree, at):
        out = []
        for level in tree[:-1]:
            run = at // fan * fan
            out.append((level[run:at], level[at + 1 : run + fan]))
            at //= fan
        return out

    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        crc = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        changed = n_chars + 1 if crc and n_chars is not None else n_chars
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), leaf(doc_id, source, lang, changed, text), doc_id))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([r[2] for r in sorted(groups[g], key=lambda r: r[:3])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, (_, _, own, changed, doc_id) in enumerate(sorted(groups[g], key=lambda r: r[:3])):
            proof, node = path(trees[g], at) + path(top, k), changed
            for left, right in proof:
                node = sha("".join([*left, node, *right]))
            out.append((doc_id, own, trees[g][-1][0], top[-1][0], sha("".join("".join(a + b) for a, b in proof)), node, node == top[-1][0]))
    return out


def made(n, langs):
    rows = [(k * 7919 % 10_007, f"text {k}" * (k % 5), langs[k % len(langs)], None if k % 11 == 0 else f"s{k % 3}", None if k % 5 == 0 else k, k, "x") for k in range(n)]
    return rows + rows[: n // 3]  # repeated rows


@pytest.mark.parametrize("n, langs, fan, levels", [(400, ["en", "de", None, "", "Zz", "ß", "en", "en"], 2, 3), (37, ["en"], 2, 8), (300, ["b", "a"], 3, 2), (130, [f"l{k}" for k in range(40)], 2, 2), (8, ["x"], 2, 1), (5, list("abcde"), 2, 1)])
def test_equals_whole_levels_in_memory(spark, n, langs, fan, levels):
    rows = made(n, langs)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted(map(tuple, merkle.verified(docs, tampered(), fan=fan, levels=levels).collect()), key=str)
    assert got == sorted(plain(rows, fan), key=str)
    assert {r[6] for r in got} == {True, False} or n < 10


def test_odd_rows(spark):
    assert merkle.verified(spark.createDataFrame([], SCHEMA), tampered()).count() == 0
    rows = [(None, None, None, None, None, 1, "a"), (None, None, None, None, None, 2, "b"), (None, "", "", "", 0, 3, "c"), (7, "é" * 200_000, "en", "s", 2**63 - 1, 4, "d"), (4, "t", "en", "s", 2**63 - 1, 4, "d")]
    got = merkle.verified(spark.createDataFrame(rows, SCHEMA), tampered()).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain(rows), key=str)
    one = merkle.verified(spark.createDataFrame([(1, "only", "en", "s", 4, 0, "")], SCHEMA), F.lit(False)).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == sha("")


def test_a_proof_stands_alone(spark):
    """A consumer with a leaf, its path and the root needs nothing else, and other columns are handed on."""
    leaves = spark.createDataFrame([(k, "g", sha(str(k)), k * 10) for k in range(21)], "id long, part string, leaf string, `tree` long")
    out = merkle.proofs(leaves, "part", "id", levels=2).collect()
    for r in out:
        node = r.leaf
        for at in r.path:
            node = sha(at.left + node + at.right)
        assert node == r.root == r.subroot and r.tree == r.id * 10 and len(r.path) == 5
