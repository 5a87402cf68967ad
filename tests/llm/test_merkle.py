"""Merkle manifests against a tree in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from matchweave.llm import merkle


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, arity=3):
    """The root of a list of nodes and the (before, after) siblings of each."""
    paths, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for j, o in enumerate(own):
            first = o // arity * arity
            paths[j].append(("".join(nodes[first:o]), "".join(nodes[o + 1:first + arity])))
            own[j] = o // arity
        nodes = [sha("".join(nodes[i:i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def plain_manifest(rows, arity=3):
    """(subroot, root, path) by row number of (order, group, leaf)."""
    groups = {}
    for i, (order, group, leaf) in sorted(enumerate(rows), key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[1][2])):
        groups.setdefault(group, []).append(i)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([rows[i][2] for i in groups[g]], arity) for g in names}
    root, ups = plain_tree([trees[g][0] for g in names], arity)
    return {i: (trees[g][0], root, own + up) for g, up in zip(names, ups) for i, own in zip(groups[g], trees[g][1])}


@pytest.mark.parametrize("arity,depth,n", [(3, 5, 400), (3, 1, 100), (2, 2, 70)])
def test_manifest_equals_plain_tree(spark, arity, depth, n):
    rnd = random.Random(arity + depth)
    rows = [(i * 3 % n, rnd.choice([None, "", "hot", "hot", "hot", "z", "é"]), sha(str(i))) for i in range(n)] + [(-5, "alone", sha("alone"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "levels int, doc_id long, source string, leaf string")
    got = merkle.manifest(df, ["doc_id"], "source", merkle.Shape(arity, depth))
    assert got.columns == ["levels", "doc_id", "source", "leaf", "subroot", "root", "path"]
    want = plain_manifest(rows, arity)
    found = got.withColumn("folded", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.subroot, r.root, [tuple(s) for s in r.path]) == want[r.levels]
        assert r.folded == r.root and r.leaf == rows[r.levels][2] and r.source == rows[r.levels][1]


def test_repeated_rows_nulls_and_no_rows(spark):
    rows = [(None, "s", sha("a")), (1, "s", sha("b")), (1, "s", sha("b")), (1, "s", sha("a")), (None, None, sha("c"))]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    got = merkle.manifest(df, ["doc_id"], "source")
    want = plain_manifest(rows)
    key = lambda r: (str(r[0]), str(r[1]), r[2], r[5])
    assert sorted([(r.doc_id, r.source, r.leaf, r.subroot, r.root, [tuple(s) for s in r.path]) for r in got.collect()], key=key) == sorted(
        [(*row, *want[i]) for i, row in enumerate(rows)], key=key)
    assert merkle.manifest(df.limit(0), ["doc_id"], "source").count() == 0
    lone = merkle.manifest(df.limit(1), ["doc_id"], "source").collect()
    assert len(lone) == 1 and lone[0].leaf == lone[0].subroot == lone[0].root and lone[0].path == []


def test_leaves_are_unambiguous_and_tampering_shows(spark):
    rows = [("1", "1:2"), ("11", ":2"), (None, ""), ("", None), ("é", "x" * 300_000), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", merkle.encoded(F.col("a"), F.col("b")).alias("e"))
    said = [r.e for r in df.collect()]
    one = lambda v: "-" if v is None else f"{len(v.encode())}:{v}"
    assert said == [one(a) + one(b) for a, b in rows] and len(set(said)) == len(rows)
    leaves = spark.range(50).select("id", F.lit("g").alias("group"), merkle.digest(F.col("id").cast("string")).alias("leaf"))
    whole = merkle.manifest(leaves, ["id"])
    bad = whole.withColumn("ok", merkle.fold(F.when(F.col("id") == 7, merkle.digest(F.lit("other"))).otherwise(F.col("leaf")), F.col("path")) == F.col("root"))
    assert [r.id for r in bad.where("not ok").collect()] == [7]
