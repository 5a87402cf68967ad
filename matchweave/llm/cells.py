"""Joins of the members of each cell, in blocks of bounded size, and the components of the links."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import stored

#: Entries of the matrix that is compared at a time inside a block pair.
STRIP = 1 << 18


def in_block_pairs(members: DataFrame, block_rows: int) -> DataFrame:
    """The members (cell, key, home and others) once for each pair of blocks that holds them.

    The home members of a cell fall into blocks of about ``block_rows`` by the hash of their key, its
    visitors into blocks of four times that, so a cell with a third of all rows becomes many groups
    of bounded size.  Each home block (``low``) meets itself, every later home block and every visitor
    block (``high``); visitors do not meet each other.  The sizes of the cells are broadcast: one
    row for each cell of a tree or list of pivots, whose length is a parameter.
    """
    home = F.col("home").cast("int")
    sizes = members.groupBy("cell").agg(F.ceil(F.sum(home) / block_rows).cast("int").alias("homes"),
                                        F.ceil(F.sum(1 - home) / (4 * block_rows)).cast("int").alias("visits"))
    hashed = F.xxhash64("key", F.lit("block"))
    block = F.when(F.col("home"), F.pmod(hashed, "homes")).otherwise(F.col("homes") + F.pmod(hashed, "visits")).cast("int")
    placed = members.join(F.broadcast(sizes.where("homes > 0")), "cell").withColumn("block", block)
    others = F.sequence(F.lit(0), F.when(F.col("home"), F.col("homes") + F.col("visits")).otherwise(F.col("homes")) - 1)
    pairs = placed.withColumn("other", F.explode(others))
    return pairs.select("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
                        "block", *[c for c in members.columns if c not in ("cell", "home")])


class Forest:
    """Numbered rows joined by links; a component is named by its smallest row."""

    def __init__(self, n: int):
        self.above = np.arange(n)

    def find(self, rows: np.ndarray) -> np.ndarray:
        """The name of each row's component as known so far."""
        top = self.above[rows]
        while (self.above[top] != top).any():
            top = self.above[top]
        self.above[rows] = top
        return top

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        """Join pairs of rows; the work depends on the number of pairs, not of rows."""
        while len(left):
            a, b = self.find(left), self.find(right)
            apart = a != b
            left, right, a, b = left[apart], right[apart], a[apart], b[apart]
            np.minimum.at(self.above, np.maximum(a, b), np.minimum(a, b))


def block_links(close: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], vectors_of: Callable[[pa.Table], np.ndarray]):
    """A function for one block pair: its links as a sum for each key and a star for each component.

    ``close`` gives the linked pairs of two arrays by index, the first index ascending.  The output has
    a row (key, root, n) for each key with a link, however many links there are; n is the weight of
    the keys it links with, or their number.
    """
    def run(table: pa.Table) -> pa.Table:
        low, one_block = table.column("low")[0].as_py(), table.column("low")[0] == table.column("high")[0]
        keys, own = table.column("key").to_numpy(), table.column("block").to_numpy() == low
        weight = table.column("weight").to_numpy() if "weight" in table.column_names else np.ones(len(keys), np.int64)
        vectors, counts, forest = vectors_of(table), np.zeros(len(keys), np.int64), Forest(len(keys))
        left = np.flatnonzero(own)
        right = left if one_block else np.flatnonzero(~own)
        there, rows = vectors[right], max(1, STRIP // max(1, len(right)))
        for at in range(0, len(left), rows):
            skip = at if one_block else 0
            i, j = close(vectors[left[at:at + rows]], there[skip:])
            i, j = i + at, j + skip
            if one_block:
                i, j = i[i < j], j[i < j]
            if len(i):
                i, j = left[i], right[j]
                np.add.at(counts, i, weight[j])
                np.add.at(counts, j, weight[i])
                forest.link(i, j)
        some = np.flatnonzero(counts)
        name = forest.find(np.arange(len(keys)))
        least = np.full(len(keys), np.iinfo(np.int64).max)
        np.minimum.at(least, name, keys)
        return pa.table({"key": keys[some], "root": least[name[some]], "n": counts[some]})

    return run


def where(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the true entries of a matrix with few of them."""
    return np.divmod(np.flatnonzero(matrix), matrix.shape[1]) if matrix.size else (np.zeros(0, np.int64),) * 2


LINKS = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "root", "n")])


def links(members: DataFrame, close, vectors_of, block_rows: int) -> DataFrame:
    """(key, root, n) from each block pair: see ``block_links``."""
    pairs = in_block_pairs(members, block_rows)
    return pairs.groupBy("cell", "low", "high").applyInArrow(block_links(close, vectors_of), LINKS)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(key, component) of every key of the edges; a component's name is its smallest key.

    Large and small stars in turn: each key is tied to its smallest neighbour until nothing changes.
    Neighbours are reduced to their minimum before a shuffle, and each round is stored, so a key with
    very many edges is spread over tasks and no lineage grows.  What joins a hot key is stored before,
    so that both sides are plain shuffles, whose large partitions Spark splits.
    """
    now = stored(edges.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).where("high > low").distinct(), "edges")
    state = None
    while True:
        both = now.unionAll(now.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = stored(both.groupBy("high").agg(F.min("low").alias("m")).select(
            F.col("high").alias("low"), F.least("high", "m").alias("m")), "least")
        large = now.join(least, "low").select("high", F.col("m").alias("low")).distinct()
        least = large.groupBy("high").agg(F.min("low").alias("m"))
        tied = large.join(least, "high").where("low > m").select(F.col("low").alias("high"), F.col("m").alias("low"))
        now = stored(tied.unionAll(least.select("high", F.col("m").alias("low"))).distinct(), "edges")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    return now.select(F.col("high").alias("key"), F.col("low").alias("component")).unionAll(
        now.select(F.col("low").alias("key"), F.col("low").alias("component")).distinct())
