"""Exact scoring of every query against every item without materialising the pairs.

Queries fall into blocks and items into slices, both by the hash of their unique keys, so no value of any
attribute can make one large.  Each block meets each slice in one bounded cell of a grid, where a small numpy
state keeps, per query, only what the answer needs (the best k).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave.session import ship

# Bounds of one cell.
QUERIES_PER_BLOCK = 512
ITEMS_PER_SLICE = 50_000
SCORE_DIGITS = 9
#: Characters of text in one cell, and those taken apart at a time.
CHARS_PER_SLICE, CHARS_AT_ONCE = 32 << 20, 1 << 20


def scan(queries: DataFrame, items: DataFrame, query_key: str, item_key: str,
         make_state: Callable[[pd.DataFrame], object], schema: str, *,
         queries_per_block: int = QUERIES_PER_BLOCK, items_per_slice: int = ITEMS_PER_SLICE, text: str | None = None) -> DataFrame:
    """Run ``make_state(queries).add(items).result()`` over all (query, item) combinations.

    Slices are bounded by rows and, if a column ``text`` is named, by its characters too.
    """
    ship()
    cores = items.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, math.ceil(queries.count() / queries_per_block))
    rows, chars = items.agg(F.count("*"), F.sum(F.length(text)) if text else F.lit(0)).first()
    n_slices = max(cores, math.ceil(rows / items_per_slice), math.ceil((chars or 0) / CHARS_PER_SLICE))

    def cell(key: str, n: int):
        return F.pmod(F.xxhash64(key), F.lit(n))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = (queries.withColumn("_block", cell(query_key, n_blocks))
            .withColumn("_slice", every(n_slices)))
    right = (items.withColumn("_slice", cell(item_key, n_slices))
             .withColumn("_block", every(n_blocks)))

    def run(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        state = make_state(q)
        if len(q) and len(i):
            state.add(i)
        return state.result()

    return left.groupBy("_block", "_slice").cogroup(right.groupBy("_block", "_slice")).applyInPandas(
        run, schema)


class TopK:
    """The k lowest scores per query, ties by item key."""

    def __init__(self, query_keys: pd.Series, limits: np.ndarray):
        self.query_keys = query_keys.to_numpy()
        self.limits = np.asarray(limits, dtype=np.int64)
        self.cut = np.full(len(self.query_keys), np.inf)
        self.q = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.item = None
        self.pending = 0

    def offer(self, first_query: int, scores: np.ndarray, item_keys: np.ndarray) -> None:
        """``scores[i, j]`` of query ``first_query + i`` and item j; infinite means no match."""
        cut = self.cut[first_query:first_query + len(scores)]
        most = int(self.limits[first_query:first_query + len(scores)].max(initial=1))
        if scores.shape[1] > most:
            # No row beyond the batch's own k-th score (ties included) can be an answer.
            cut = np.minimum(cut, np.partition(scores, most - 1, axis=1)[:, most - 1])
        q, j = np.nonzero((scores <= cut[:, None]) & np.isfinite(scores))
        items = item_keys[j]
        self.q = np.concatenate([self.q, q + first_query])
        self.score = np.concatenate([self.score, scores[q, j]])
        self.item = items if self.item is None else np.concatenate([self.item, items])
        self.pending += len(q)
        if self.pending > 1_000_000:
            self.prune()

    def prune(self) -> None:
        self.pending = 0
        if self.item is None or not len(self.q):
            return
        order = np.lexsort((self.item, self.score, self.q))
        q = self.q[order]
        starts = np.searchsorted(q, q, side="left")
        rank = np.arange(len(q)) - starts
        keep = order[rank < self.limits[q]]
        self.q, self.score, self.item = self.q[keep], self.score[keep], self.item[keep]
        counts = np.bincount(self.q, minlength=len(self.query_keys))
        full = counts >= self.limits
        ends = np.cumsum(counts) - 1
        if len(self.q):
            self.cut = np.where(full & (counts > 0), self.score[np.maximum(ends, 0)], np.inf)

    def frame(self, query_key: str, item_key: str, score: str) -> pd.DataFrame:
        self.prune()
        if self.item is None:
            return pd.DataFrame({query_key: [], item_key: [], score: []})
        return pd.DataFrame({query_key: self.query_keys[self.q], item_key: self.item, score: self.score})


def sortable(keys: pd.Series) -> np.ndarray:
    """Keys as an array numpy can order (fixed-width text instead of objects)."""
    return keys.to_numpy(dtype=str) if keys.dtype == object else keys.to_numpy()


def _batches(n: int, size: int):
    return range(0, n, max(1, size))


def _best(df: DataFrame, query_key: str, item_key: str, order, limit) -> DataFrame:
    """Final ranks; the per-partition limit of the window keeps the shuffle at k rows a task."""
    w = Window.partitionBy(query_key).orderBy(*order, item_key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


# ---------------------------------------------------------------- keyword top-k
class _KeywordState:
    """BM25 scores of spaced texts; term weights of the queries already hold the IDF."""

    QUERIES = 128

    def __init__(self, queries: pd.DataFrame, query_key: str, item_key: str, digits: int,
                 k1: float, b: float):
        self.query_key, self.item_key, self.digits = query_key, item_key, digits
        self.k1, self.b = k1, b
        self.avgdl = float(queries["_avgdl"].iloc[0]) if len(queries) else 1.0
        self.top = TopK(queries[query_key], queries["_k"].to_numpy())
        self.codes: dict[str, int] = {}
        self.blocks = []
        for at in _batches(len(queries), self.QUERIES):
            part = queries.iloc[at:at + self.QUERIES]
            cells = [(row, self.codes.setdefault(term, len(self.codes)), weight)
                     for row, (ts, ws) in enumerate(zip(part["_terms"], part["_weights"]))
                     for term, weight in zip(ts, ws)]
            row, code, weight = (np.array(c) for c in zip(*cells))
            used, local = np.unique(code, return_inverse=True)
            weights = np.zeros((len(part), len(used)))
            weights[row, local] = weight
            self.blocks.append((at, used, weights))

    def add(self, items: pd.DataFrame) -> None:
        """Score the items; the words of a bounded part of them are held at a time."""
        part = np.cumsum(items["_text"].map(len).to_numpy()) // CHARS_AT_ONCE
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(items)]
        for at, end in zip(edges, edges[1:]):
            self._add(items.iloc[at:end])

    def _add(self, items: pd.DataFrame) -> None:
        if not len(items):
            return
        keys = sortable(items[self.item_key])
        words = [t.split() for t in items["_text"]]
        length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        code = np.fromiter((self.codes.get(w, -1) for ws in words for w in ws),
                           dtype=np.int64, count=int(length.sum()))
        doc = np.repeat(np.arange(len(words)), length)
        cell, tf = np.unique((doc * len(self.codes) + code)[code >= 0], return_counts=True)
        doc, code = np.divmod(cell, max(1, len(self.codes)))
        share = length[doc] / self.avgdl
        value = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * share))
        for at, used, weights in self.blocks:
            local = np.searchsorted(used, code)
            local[local == len(used)] = 0
            mine = used[local] == code
            step = max(1, 4_000_000 // len(used))
            for lo in _batches(len(words), step):
                inside = mine & (doc >= lo) & (doc < lo + step)
                table = np.zeros((len(used), min(step, len(words) - lo)))
                table[local[inside], doc[inside] - lo] = value[inside]
                scores = np.round(weights @ table, self.digits)
                self.top.offer(at, np.where(scores > 0, -scores, np.inf), keys[lo:lo + step])

    def result(self) -> pd.DataFrame:
        return self.top.frame(self.query_key, self.item_key, "score")


def keyword_topk(queries: DataFrame, items: DataFrame, k: int, *, query_key: str, item_key: str,
                 k1: float, b: float, digits: int = 6, **layout) -> DataFrame:
    """(query, item, score, rank): the k best texts of every query.

    ``queries`` carry ``terms, weights`` and the corpus' mean length ``avgdl``; ``items`` carry
    ``_text``.
    """
    q = queries.select(query_key, F.col("terms").alias("_terms"), F.col("weights").alias("_weights"),
                       F.col("avgdl").alias("_avgdl"), F.lit(k).alias("_k"))
    schema = (f"{query_key} {q.schema[query_key].dataType.simpleString()}, "
              f"{item_key} {items.schema[item_key].dataType.simpleString()}, score double")
    hits = scan(q, items, query_key, item_key,
                lambda pdf: _KeywordState(pdf, query_key, item_key, digits, k1, b), schema, text="_text", **layout)
    hits = hits.withColumn("score", -F.col("score"))
    return _best(hits, query_key, item_key, [F.col("score").desc()], k)
