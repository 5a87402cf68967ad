"""Merkle manifests of datasets: ternary hash trees whose levels are strings of digests.

The rows of a group are leaves in order.  An aligned block of ``arity ** depth`` of them keeps each of
its levels as one string of hexadecimal digests: substrings of fixed width hash to the next level, and
the substrings on both sides of a node are its siblings.  What a block ends in is a node of the same
kind of tree above it, and the roots of the groups are leaves of one more.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import numbered, stored

#: Characters of a digest.
WIDTH = 64


def digest(value: Column) -> Column:
    """Lowercase hexadecimal sha256 of a string or binary."""
    return F.sha2(value.cast("binary"), 256)


def encoded(*columns: Column) -> Column:
    """The values one after another: ``-`` for a null, else the number of UTF-8 bytes, ``:`` and the value."""
    words = [c.cast("string") for c in columns]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(w).cast("string"), F.lit(":"), w), F.lit("-")) for w in words])


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings (before, after) on its way up lead to."""
    return F.aggregate(path, leaf, lambda node, s: digest(F.concat(s["before"], node, s["after"])))


def proof(path: Column) -> Column:
    """All siblings on the way up, left to right on each level, as one string of digests."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


@dataclasses.dataclass(frozen=True)
class Shape:
    """``arity`` nodes have a parent; a block has ``depth`` levels above its leaves."""

    arity: int = 3
    depth: int = 5

    @property
    def size(self) -> int:
        return self.arity ** self.depth

    def parents(self, level: Column) -> Column:
        """The level above a level (binary): its runs of ``arity`` digests, hashed."""
        run = self.arity * WIDTH
        last = F.floor((F.octet_length(level) - 1) / run).cast("int")
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: digest(F.substring(level, i * run + 1, run)))
        return F.array_join(hashed, "").cast("binary")

    def levels(self, leaves: Column, more: Column) -> Column:
        """The levels of a block from its leaves (binary) up; ``more``: the group has other blocks.

        A block that is alone stops at one node; any other has all its levels, as its nodes meet others above.
        """
        def step(done, _):
            top = F.element_at(done, -1)
            return F.concat(done, F.array(F.when(more | (F.octet_length(top) > WIDTH), self.parents(top)).otherwise(top)))

        return F.aggregate(F.sequence(F.lit(1), F.lit(self.depth)), F.array(leaves), step)

    def path(self, levels: Column, more: Column, at: Column) -> Column:
        """The siblings (before, after) of leaf ``at`` on each level of its block."""
        def siblings(k):
            level = F.get(levels, k)
            own = F.floor(at / F.pow(F.lit(self.arity), k)).cast("int")
            first = own - own % self.arity
            cut = lambda start, n: F.substring(level, start * WIDTH + 1, n * WIDTH).cast("string")
            both = F.struct(cut(first, own - first).alias("before"), cut(own + 1, first + self.arity - 1 - own).alias("after"))
            return F.when(more | (F.octet_length(level) > WIDTH), both)

        return F.filter(F.transform(F.sequence(F.lit(0), F.lit(self.depth - 1)), siblings), lambda s: s.isNotNull())


def _blocks(nodes: DataFrame, shape: Shape) -> DataFrame:
    """(key, block, total, rows, levels) of nodes (key, n, total, node, ...); the rows of a block are in order."""
    rest = [c for c in nodes.columns if c not in ("key", "total")]
    block = F.floor(F.col("n") / shape.size).cast("long")
    grouped = nodes.groupBy("key", block.alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("n", *[c for c in rest if c != "n"]))).alias("rows"))
    leaves = F.array_join(F.transform("rows", lambda r: r["node"]), "").cast("binary")
    return grouped.withColumn("levels", shape.levels(leaves, F.col("total") > shape.size))


def _grow(nodes: DataFrame, shape: Shape) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each round, from the leaves up, and (key, node), the roots of the groups."""
    rounds, roots = [], None
    top = F.element_at("levels", -1).cast("string").alias("node")
    while True:
        blocks = stored(_blocks(nodes, shape), "merkle-blocks")
        rounds.append(blocks)
        ended = blocks.where(F.col("total") <= shape.size).select("key", top)
        roots = ended if roots is None else roots.unionAll(ended)
        going = blocks.where(F.col("total") > shape.size)
        if going.isEmpty():
            return rounds, roots
        nodes = going.select("key", F.col("block").alias("n"), F.ceil(F.col("total") / shape.size).alias("total"), top)


def _descend(rounds: list[DataFrame], above: DataFrame, shape: Shape) -> DataFrame:
    """(key, the columns of the leaves, and those of ``above``) with ``path`` up to the end.

    ``above`` has key, path and others for each group: where the way goes on from its root.  What comes
    from above is joined to whole blocks, before their leaves become rows.
    """
    more, down = F.col("total") > shape.size, None
    ways = [c for c in above.columns if c != "key"]
    for blocks in reversed(rounds):
        over = blocks.where(~more).select("key", "block").join(above, "key")
        over = over if down is None else over.unionByName(down)
        names = blocks.schema["rows"].dataType.elementType.names
        row = lambda r: F.struct(*[r[c].alias(c) for c in names], F.concat(
            shape.path(F.col("levels"), more, (r["n"] - F.col("block") * shape.size).cast("int")), F.col("path")).alias("path"))
        out = blocks.join(over, ["key", "block"]).select("key", *[c for c in ways if c != "path"], F.inline(F.transform("rows", row)))
        down = out.select("key", F.col("n").alias("block"), *ways)
    return out


def manifest(leaves: DataFrame, order: list[str], group: str = "group", shape: Shape = Shape()) -> DataFrame:
    """``leaves`` with subroot, root and ``path``: (before, after) siblings on the way up.

    ``leaves`` has a column ``leaf`` (a digest) and ``group``; its other columns are kept, but their names
    must not be those of the result.  Leaves of a group ascend by ``order``, nulls first, then by digest (leaves
    equal in both are the same node twice).  While several nodes remain, each run of ``arity`` is
    hashed, a last run however short; the groups' roots, a null group first, then by UTF-8 bytes, lead
    to the root in the same way.  No leaves: no rows.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key")
    rest = [c for c in leaves.columns if c != "leaf"]
    rows = numbered(leaves.select(key, F.col("leaf").alias("node"), *rest), "key", [*order, "node"])
    rounds, subroots = _grow(rows, shape)
    one = numbered(subroots.select(F.lit("").alias("key"), F.col("key").alias("group_key"), "node"), "key", ["group_key"])
    tops, root = _grow(one, shape)
    start = root.select("key", F.col("node").alias("root"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    above = stored(_descend(tops, start, shape).select(F.col("group_key").alias("key"), F.col("node").alias("subroot"), "root", "path"), "merkle-above")
    return _descend(rounds, above, shape).select(*rest, F.col("node").alias("leaf"), "subroot", "root", "path")
