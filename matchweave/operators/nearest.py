"""The nearest items of every query by cosine distance, exactly, without scoring every pair.

Items fall to the nearest of some pivots; a cell knows its radius.  Unit vectors keep the triangle inequality,
so nothing in a cell is nearer to a query than the distance to its pivot less the radius.  A query first visits the
slice of cells that holds the nearest pivot; its k-th distance there says which other slices may still hold an answer, and
only those are visited, for what is nearer.  Inside a slice the nearest cells come first and say the same of the others.
Both visits are joins of blocks of queries with slices of cells, of bounded size.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.operators.blocked import SCORE_DIGITS, sortable
from matchweave.session import ship
from matchweave.sources.tables import materialize

#: Pivots at most (a bound on what the driver and each task hold), and the items a cell should have.
MAX_PIVOTS, CELL_ROWS = 256, 4096
#: Numbers in the vectors of a slice of items and of a block of queries, and the scores held at a time.
SLICE_NUMBERS, BLOCK_NUMBERS, BATCH_SCORES = 12_800_000, 1 << 20, 4_000_000
#: Rows that a block or slice should not fall under to occupy more cores.
LEAST_QUERIES, LEAST_ITEMS = 512, 1024
#: Every so many-th item of a long run is looked at first, to know what can be left out of the rest.
SAMPLED = 16
#: Items that the first visits of a query should meet, as a multiple of what it asks for.
SEED_FACTOR = 4
#: The distance of a vector without a direction (null, zero or not finite): as far as a vector can be.
UNDEFINED = 2.0
#: Distances between unit vectors count as smaller by this when cells are left out, for rounding.
SLACK = 1e-7


def unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 in double precision, and which vectors have a direction; the others are rows of zeros."""
    width = max((len(v) for v in vectors if v is not None), default=0)
    rows = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        if v is not None and len(v) == width:
            rows[i] = np.asarray(v, np.float64)
    rows[~np.isfinite(rows).all(axis=1)] = 0
    size = np.linalg.norm(rows, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(size[:, None] > 0, rows / size[:, None], 0.0), size > 0


def chord(cosines: np.ndarray) -> np.ndarray:
    """The distance of unit vectors by their cosine."""
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class Rules:
    """What each query asks of an item: a token of every list, and a fee within its budget (0: any)."""

    def __init__(self, queries: pd.DataFrame, items: pd.DataFrame):
        codes: dict[str, int] = {}
        self.asked = [[[codes.setdefault(t, len(codes)) for t in any_of] for any_of in lists] for lists in queries["rules"]]
        self.budgets, self.fees = queries["budget"].to_numpy(dtype=np.int64), items["fee_floor"].to_numpy(dtype=np.int64)
        self.has = np.zeros((len(codes), len(items)), bool)
        code = pd.Index(list(codes)).get_indexer(items["facets"].explode().to_numpy(dtype=object))
        place = np.repeat(np.arange(len(items)), np.maximum(items["facets"].map(len).to_numpy(), 1))
        self.has[code[code >= 0], place[code >= 0]] = True

    def admit(self, queries: np.ndarray, items: slice) -> np.ndarray:
        """Which of the items each of the queries admits."""
        budget, has = self.budgets[queries][:, None], self.has[:, items]
        out = (budget == 0) | (self.fees[items][None, :] <= budget)
        for row, query in zip(out, queries):
            for any_of in self.asked[query]:
                row &= has[any_of].any(axis=0)
        return out


class Buckets:
    """Queries and items admit each other that share the bucket of a projection."""

    def __init__(self, queries: pd.DataFrame, items: pd.DataFrame):
        self.asked, self.held = (np.array(rows["_buckets"].tolist(), np.int32).T.copy() for rows in (queries, items))

    def admit(self, queries: np.ndarray, items: slice) -> np.ndarray:
        out = np.zeros((len(queries), len(range(*items.indices(self.held.shape[1])))), bool)
        for asked, held in zip(self.asked, self.held):
            out |= asked[queries][:, None] == held[items][None, :]
        return out

    def pairs(self, queries: np.ndarray, items: np.ndarray) -> np.ndarray:
        """Whether pairs of a query and an item share a bucket."""
        return (self.asked[:, queries] == self.held[:, items]).any(axis=0)


class _Block:
    """A block of queries and a slice of items, the items by cell; the queries are answered in batches of one nearest cell."""

    def __init__(self, q: pd.DataFrame, i: pd.DataFrame, item_key: str, digits: int, pivots: np.ndarray):
        i = i.sort_values("_cell", kind="stable", ignore_index=True)
        self.digits, self.margin, self.scored = digits, 10.0 ** -digits, 0
        self.k, self.named, self.keys = q["_k"].to_numpy(), i[item_key].to_numpy(), sortable(i[item_key])
        self.vectors, self.known = unit(i["_vector"])
        self.asked, self.directed = unit(q["_vector"])
        self.cut = q["_cut"].to_numpy(dtype=np.float64) if "_cut" in q else np.full(len(q), np.inf)
        self.rules = Rules(q, i) if "rules" in q else None
        self.buckets = Buckets(q, i) if "_buckets" in q else None
        self.cells, self.starts = np.unique(i["_cell"].to_numpy(), return_index=True)
        self.ends = np.append(self.starts[1:], len(i))
        self.apart, self.bound = np.zeros((2, len(q), len(self.cells)))
        if len(pivots) > 1:
            self._bounds(i["_far"].to_numpy(), pivots)
        self.batch = max(1, BATCH_SCORES // len(i))

    def _bounds(self, far: np.ndarray, pivots: np.ndarray) -> None:
        """How far each query is from the pivots of the cells, and how near an item of the cell may be."""
        self.apart[:], self.bound[:] = UNDEFINED, UNDEFINED
        if self.asked.shape[1] == pivots.shape[1]:
            real = np.ix_(self.directed, self.cells >= 0)
            self.apart[real] = chord(self.asked[self.directed] @ pivots[self.cells[self.cells >= 0]].T)
            radius = np.maximum.reduceat(far, self.starts)[self.cells >= 0]
            self.bound[real] = np.maximum(self.apart[real] - radius, 0)

    def _runs(self, chosen: np.ndarray):
        """The items of the chosen cells, as (first, end) of the longest runs."""
        runs = []
        for c in np.flatnonzero(chosen):
            if runs and runs[-1][1] == self.starts[c]:
                runs[-1][1] = self.ends[c]
            else:
                runs.append([self.starts[c], self.ends[c]])
        return runs

    def _near(self, rows: np.ndarray, cut: np.ndarray, chosen: np.ndarray) -> list:
        """(place in rows, item, distance) of what may be among the best in the chosen cells: all within the cut, at least."""
        found, k = [], int(self.k[rows].max())
        for a, b in self._runs(chosen):
            self.scored += len(rows) * (b - a)
            if self.asked.shape[1] == self.vectors.shape[1]:
                near = self.asked[rows] @ self.vectors[a:b].T
            else:
                near = np.full((len(rows), b - a), 1 - UNDEFINED)
            near[~self.directed[rows]] = 1 - UNDEFINED
            near[:, ~self.known[a:b]] = 1 - UNDEFINED
            if self.rules is not None:
                near[~self.rules.admit(rows, slice(a, b))] = -np.inf
            low = 1 - cut - self.margin
            if b - a > 4 * SAMPLED * k:  # the k-th best of some items is no better than that of all
                some = near[:, ::SAMPLED]
                if self.buckets is not None:
                    some = np.where(self.buckets.admit(rows, slice(a, b, SAMPLED)), some, -np.inf)
                low = np.maximum(low, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k] - self.margin)
            place, item = np.divmod(np.flatnonzero(near >= np.maximum(low, -2.0)[:, None]), b - a)
            distance = np.round(1.0 - near[place, item], self.digits) + 0.0  # no -0.0
            kept = distance <= cut[place]
            if self.buckets is not None:
                kept &= self.buckets.pairs(rows[place], item + a)
            found.append((place[kept], item[kept] + a, distance[kept]))
        return found

    def _trimmed(self, rows: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best of each query, ties by the item's key."""
        place, item, distance = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((self.keys[item], distance, place))
        place = place[order]
        kept = np.arange(len(place)) - np.searchsorted(place, place) < self.k[rows][place]
        return place[kept], item[order][kept], distance[order][kept]

    def answers(self):
        """(query, item, distance) by place, a batch of queries at a time."""
        home = self.apart.argmin(axis=1)
        order = np.argsort(home, kind="stable")
        ends = np.append(np.flatnonzero(np.diff(home[order])) + 1, len(order))
        for first, end in zip(np.append(0, ends[:-1]), ends):
            for at in range(first, end, self.batch):
                yield self._answer(order[at:min(end, at + self.batch)])

    def _answer(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by = self.apart[rows].mean(axis=0).argsort(kind="stable")
        met = np.cumsum((self.ends - self.starts)[by])
        seeds = np.zeros(len(by), bool)
        seeds[by[:np.searchsorted(met, SEED_FACTOR * self.k[rows].max()) + 1]] = True
        best, cut = self._trimmed(rows, self._near(rows, self.cut[rows], seeds)), self.cut[rows].copy()
        counts = np.bincount(best[0], minlength=len(rows))
        full = (counts >= self.k[rows]) & (counts > 0)
        cut[full] = np.minimum(cut[full], best[2][np.cumsum(counts)[full] - 1])
        rest = ~seeds & (self.bound[rows] <= np.sqrt(2 * cut)[:, None] + SLACK).any(axis=0)
        if rest.any():
            best = self._trimmed(rows, [best, *self._near(rows, cut, rest)])
        return rows[best[0]], best[1], best[2]


class Search:
    """One search: the cells of the items, how they fill slices, and the two rounds of visits.

    ``cells`` lists (cell, radius, items) of the cells that are not empty; a cell of its own holds the items
    without a direction.  Blocks of queries and slices of cells are as large as memory allows, as each item is sent once
    to each block and each query has its best in each slice it visits.  ``scored`` is what ``share`` reports.
    """

    def __init__(self, queries: DataFrame, items: DataFrame, query_key: str, item_key: str, *, digits: int = SCORE_DIGITS,
                 max_pivots: int = MAX_PIVOTS, cell_rows: int = CELL_ROWS, queries_per_block: int | None = None,
                 items_per_slice: int | None = None):
        ship()
        self.query_key, self.item_key, self.digits = query_key, item_key, digits
        self.spark = items.sparkSession
        rows, width = items.agg(F.count("*"), F.max(F.size("_vector"))).first()
        asked = queries.agg(F.count("*"), F.max("_k")).first()
        self.rows, self.n_queries, self.k = rows, asked[0], asked[1] or 1
        self._sizes(max(1, width or 1), queries_per_block, items_per_slice)
        self.pivots = self._pivots(items, min(max_pivots, rows // cell_rows))
        self.items = self._placed(items, self.pivots)
        if len(self.pivots) > 1:
            self.items = materialize(self.items, "cells")
            found = self.items.groupBy("_cell").agg(F.max("_far").alias("far"), F.count("*").alias("n")).collect()
            self.cells = sorted((r["_cell"], r["far"], r["n"]) for r in found)
        else:
            self.cells = [(0, 2.0, rows)]
        self.places = self._slices()
        self.queries = queries.join(self._ways(queries), query_key) if len(self.pivots) > 1 else queries

    def _sizes(self, width: int, queries_per_block: int | None, items_per_slice: int | None) -> None:
        """The number of blocks, and the items of a slice: bounded by memory, and enough of both for all cores."""
        cores = max(1, self.spark.sparkContext.defaultParallelism)
        full = items_per_slice or max(1, SLICE_NUMBERS // width)
        slices = max(1, math.ceil(self.rows / full))
        spread = min(math.ceil(2 * cores / slices), math.ceil(self.n_queries / LEAST_QUERIES))
        self.blocks = max(1, spread, math.ceil(self.n_queries / (queries_per_block or max(1, BLOCK_NUMBERS // width))))
        slices = max(slices, min(math.ceil(cores / self.blocks), math.ceil(self.rows / LEAST_ITEMS)))
        self.items_per_slice = max(1, math.ceil(self.rows / slices))

    def _slices(self) -> dict[int, tuple[int, int]]:
        """The first slice of each cell and how many it fills: small cells share one, a large one has several."""
        places, at, held = {}, 0, 0
        for cell, _, n in self.cells:
            parts = max(1, math.ceil(n / self.items_per_slice))
            if held and (parts > 1 or held + n > self.items_per_slice):
                at, held = at + 1, 0
            places[cell] = (at, parts)
            at, held = (at + parts, 0) if parts > 1 else (at, held + n)
        return places

    def _pivots(self, items: DataFrame, n: int) -> np.ndarray:
        """At most ``n`` unit vectors: those of the items with the smallest hashes of their keys."""
        if n < 2:
            return np.zeros((0, 0))
        rows = items.where(F.col("_vector").isNotNull()).orderBy(F.xxhash64(self.item_key), self.item_key).limit(n)
        vectors, known = unit(rows.select("_vector").toPandas()["_vector"])
        return np.unique(vectors[known], axis=0)

    def _placed(self, items: DataFrame, pivots: np.ndarray) -> DataFrame:
        """``items`` with the cell of each and its distance to the pivot; -1 is the cell without directions."""
        if len(pivots) < 2:
            return items.withColumn("_cell", F.lit(0))
        sent = self.spark.sparkContext.broadcast(pivots)

        def run(batches):
            for batch in batches:
                vectors, known = unit(batch["_vector"])
                if vectors.shape[1] != sent.value.shape[1]:
                    vectors, known = np.zeros((len(batch), sent.value.shape[1])), np.zeros(len(batch), bool)
                near = vectors @ sent.value.T
                cell = near.argmax(axis=1)
                far = chord(near[np.arange(len(batch)), cell])
                yield batch.assign(_cell=np.where(known, cell, -1).astype(np.int32), _far=np.where(known, far, UNDEFINED))

        return items.mapInPandas(run, T.StructType([*items.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_far", T.DoubleType())]))

    def _ways(self, queries: DataFrame) -> DataFrame:
        """(query, home, bounds): the slice of the nearest cell, and for each slice how near its nearest item may be."""
        first, parts = (np.array([self.places[c][n] for c, _, _ in self.cells]) for n in (0, 1))
        sent = self.spark.sparkContext.broadcast((self.pivots, np.array([c[:2] for c in self.cells]), first, parts))

        def run(batches):
            pivots, cells, first, parts = sent.value
            number, radius = cells[:, 0].astype(int), cells[:, 1]
            for batch in batches:
                vectors, known = unit(batch["_vector"])
                known &= vectors.shape[1] == pivots.shape[1]
                apart = np.full((len(batch), len(number)), UNDEFINED)
                if known.any():
                    apart[known] = np.where(number >= 0, chord(vectors[known] @ pivots[np.maximum(number, 0)].T), UNDEFINED)
                bound = np.where((number >= 0) & known[:, None], np.maximum(apart - radius, 0), UNDEFINED)
                bounds = np.full((len(batch), int((first + parts).max())), UNDEFINED)
                for c in range(len(number)):
                    there = slice(first[c], first[c] + parts[c])
                    bounds[:, there] = np.minimum(bounds[:, there], bound[:, c:c + 1])
                yield pd.DataFrame({self_key: batch[self_key], "home": first[apart.argmin(axis=1)].astype(np.int32), "bounds": list(bounds)})

        self_key = self.query_key
        key = queries.schema[self_key].dataType.simpleString()
        return queries.select(self_key, "_vector", "_k").mapInPandas(run, f"{self_key} {key}, home int, bounds array<double>")

    def _visit(self, visits: DataFrame, count: bool = False, some: bool = False) -> DataFrame:
        """(query, item, distance): the best of each query in each slice it visits (query columns, ``_slice``); or (scored).

        With ``some`` only the blocks that visit a slice get its items, for which the visits are read once more.
        """
        places = F.create_map(*[F.lit(x) for c, place in self.places.items() for x in (c, F.array(*map(F.lit, place)))])
        place = F.element_at(places, F.col("_cell"))
        block = F.pmod(F.xxhash64(self.query_key), F.lit(self.blocks))
        left = visits.withColumn("_block", block)
        right = self.items.withColumn("_slice", (place[0] + F.pmod(F.xxhash64(self.item_key), place[1])).cast("int"))
        if some:  # "_at" names the block, so that the keys of both sides differ where both come from one table
            right = right.join(F.broadcast(left.select("_slice", F.col("_block").alias("_at")).distinct()), "_slice")
        else:
            right = right.withColumn("_at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.blocks - 1).cast("bigint"))))
        query_key, item_key, digits = self.query_key, self.item_key, self.digits
        kind = lambda df, c: df.schema[c].dataType.simpleString()
        sent = self.spark.sparkContext.broadcast(self.pivots)

        def run(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
            nothing = pd.DataFrame({c: [] for c in (["scored"] if count else [query_key, item_key, "distance"])}, dtype=object)
            if not len(q) or not len(i):
                return nothing
            block = _Block(q, i, item_key, digits, sent.value)
            query, item, distance = (np.concatenate(x) for x in zip(*block.answers()))
            if count:
                return pd.DataFrame({"scored": [block.scored]})
            return pd.DataFrame({query_key: q[query_key].to_numpy()[query], item_key: block.named[item], "distance": distance}) if len(query) else nothing

        return left.groupBy("_slice", "_block").cogroup(right.withColumnRenamed("_slice", "_there").groupBy("_there", "_at")).applyInPandas(
            run, "scored bigint" if count else f"{query_key} {kind(visits, query_key)}, {item_key} {kind(self.items, item_key)}, distance double")

    def _ranked(self, hits: DataFrame) -> DataFrame:
        w = Window.partitionBy(self.query_key).orderBy("distance", self.item_key)
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)

    def _best(self, hits: DataFrame) -> DataFrame:
        limits = self.queries.select(self.query_key, "_k")
        return self._ranked(hits).join(limits, self.query_key).where("rank <= _k").drop("_k")

    def _everywhere(self) -> DataFrame:
        """Visits of all queries to all slices."""
        n = max(first + parts for first, parts in self.places.values())
        return self.queries.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def run(self) -> DataFrame:
        """(query, item, distance, rank)."""
        if len(self.cells) == 1:
            return self._best(self._visit(self._everywhere()))
        first = materialize(self._best(self._visit(self._first())), "seeds")
        return self._best(first.drop("rank").unionByName(self._visit(self._left(first), some=True)))

    def _first(self) -> DataFrame:
        return self.queries.withColumn("_slice", F.col("home")).drop("home", "bounds")

    def _left(self, first: DataFrame) -> DataFrame:
        """The visits that the k-th distance of the first ones leaves; all, if they found fewer than k."""
        last = first.groupBy(self.query_key).agg(F.max("rank").alias("_n"), F.max("distance").alias("_last"))
        cut = F.when(F.col("_n") >= F.col("_k"), F.col("_last")).otherwise(F.lit(float("inf")))
        rows = self.queries.join(last, self.query_key, "left").withColumn("_cut", cut)
        along = rows.select("*", F.posexplode("bounds").alias("_slice", "_bound")).where(
            (F.col("_slice") != F.col("home")) & (F.col("_bound") <= F.sqrt(2 * F.col("_cut")) + SLACK))
        return along.drop("home", "bounds", "_bound", "_n", "_last")

    def share(self) -> DataFrame:
        """One row (cells, pairs, scored): the pairs of a query and an item, and how many of them ``run`` compares."""
        pairs = self.rows * self.n_queries
        if len(self.cells) == 1:
            return self.spark.range(1).select(F.lit(1).alias("cells"), F.lit(pairs).alias("pairs"), F.lit(pairs).alias("scored"))
        first = materialize(self._best(self._visit(self._first())), "seeds")
        visits = self._visit(self._first(), count=True).unionAll(self._visit(self._left(first), count=True, some=True))
        return visits.agg(F.lit(len(self.cells)).alias("cells"), F.lit(pairs).cast("bigint").alias("pairs"), F.sum("scored").alias("scored"))


def nearest_search(queries: DataFrame, items: DataFrame, k: int, *, query_key: str = "query_id", item_key: str = "id",
                   vector: str = "embedding", **options) -> Search:
    q = queries.select(F.col(query_key), F.col(vector).alias("_vector"), F.lit(k).alias("_k"))
    i = items.where(F.col(vector).isNotNull()).select(F.col(item_key), F.col(vector).alias("_vector"))
    return Search(q, i, query_key, item_key, **options)


def vector_topk(queries: DataFrame, items: DataFrame, k: int, **options) -> DataFrame:
    """(query, item, distance, rank): the k nearest items of every query by cosine distance, ties by the item's key.

    Items without a vector are left out.  A query without a vector, and a vector of zeros, of other than
    finite numbers or of another length, have the distance 2 to everything: they come last, and no query loses its rows.
    """
    return nearest_search(queries, items, k, **options).run()


def candidate_topk(queries: DataFrame, profiles: DataFrame, *, query_key: str = "query_id", item_key: str = "id", **options) -> DataFrame:
    """Nearest admissible profiles of every search, as ``vector_topk`` has them.

    ``queries`` carry ``embedding, demands, max_budget, level, top_k``: the demands above the level are in
    force.  ``profiles`` carry ``embedding, facets, fee_floor`` and have passed the shared hard filters.
    """
    in_force = F.filter("demands", lambda d: (d["level"] == 0) | (d["level"] > F.col("level")))
    q = queries.select(
        query_key, F.col("embedding").alias("_vector"), F.col("top_k").alias("_k"),
        F.transform(in_force, lambda d: d["any_of"]).alias("rules"),
        F.when(F.col("level") < 1, F.coalesce("max_budget", F.lit(0))).otherwise(0).alias("budget"))
    i = profiles.select(item_key, F.col("embedding").alias("_vector"), "facets", "fee_floor")
    return Search(q, i, query_key, item_key, **options).run()


def approximate_topk(queries: DataFrame, items: DataFrame, k: int, *, query_key: str = "query_id", item_key: str = "id",
                     vector: str = "embedding", bucket: float = 0.25, tables: int = 8, reach: float = 1.5) -> DataFrame:
    """(query, item, distance, rank) among the items that share a bucket of a random projection with the query.

    Unit vectors within ``reach`` of each other are looked for; ``bucket`` and ``tables`` trade work for recall, which is to be
    measured against ``vector_topk``.  Vectors without a direction are left out.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def prepared(df: DataFrame, key: str) -> DataFrame:
        size = F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        rows = df.where(F.col(vector).isNotNull() & (size > 0)).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("raw"))
        return Normalizer(inputCol="raw", outputCol="unit").transform(rows).drop("raw").distinct()

    q, i = prepared(queries, query_key), prepared(items, item_key)
    model = BucketedRandomProjectionLSH(inputCol="unit", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=1).fit(i)

    def dealt(df: DataFrame, key: str) -> DataFrame:
        buckets = F.array(*[vector_to_array(F.get("hashes", F.lit(n)))[0].cast("int") for n in range(tables)])
        return model.transform(df).select(key, vector_to_array("unit").alias("_vector"), buckets.alias("_buckets"))

    asked = dealt(q, query_key).withColumns({"_k": F.lit(k), "_cut": F.lit(reach * reach / 2)})
    search = Search(asked, dealt(i, item_key), query_key, item_key, digits=6, max_pivots=1)
    return search._ranked(search._visit(search._everywhere()))
