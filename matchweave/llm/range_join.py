"""Exact links of vectors within an angle: pivots, replicated borders, and cells joined on their own."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm import cells
from matchweave.llm.common import stored


def _valid(vector: str):
    """Whether the vector has a direction: finite components, not all zero."""
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) \
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def pivots_of(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` unit vectors of the sample that lie far apart: each next one is farthest from those chosen."""
    chosen, nearest = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, sample @ sample[chosen[-1]])
    return sample[chosen]


def assign(units: np.ndarray, pivots: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, cells and whether at home there.

    Home is the cell of the nearest pivot.  Two points within ``radius`` of each other with homes i and
    j both lie within ``radius`` of the plane midway between pivots i and j; that plane is
    (d(x,j)^2 - d(x,i)^2) / (2 d(i,j)) away, which is no less than the plain triangle bound
    (d(x,j) - d(x,i)) / 2.  A row visits the cells after its home that it may have partners in.
    """
    near = units @ pivots.T
    own = near.argmax(1)
    gap = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    with np.errstate(divide="ignore", invalid="ignore"):
        away = (near[np.arange(len(units)), own][:, None] - near) / gap[own]
    cell = np.arange(len(pivots))[None, :]
    visits = (cell > own[:, None]) & ~(away > radius + 1e-9)
    visits[np.arange(len(units)), own] = True
    rows, at = np.nonzero(visits)
    return rows, at, at == own[rows]


def _links(nodes: DataFrame, size: int, least: float, cell_rows: int, sample_rows: int, max_pivots: int,
           block_rows: int) -> DataFrame:
    """Links of the distinct vectors of one length: (key, root, n) from each block pair."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("v", F.lit("pivot"))).limit(sample_rows).select("v").collect()
    drawn = np.array([r[0] for r in sample], np.float64).reshape(len(sample), size)
    cells_wanted = min(max_pivots, max(1, math.ceil(nodes.count() / cell_rows)))
    pivots = spark.sparkContext.broadcast(pivots_of(_unit(drawn), cells_wanted))
    radius = math.sqrt(max(0.0, 2 - 2 * least))

    def route(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, size)
            units, keys, copies = _unit(raw), batch.column("key").to_numpy(), batch.column("copies").to_numpy()
            for at in range(0, len(units), 1024):
                part = units[at:at + 1024]
                rows, cell, home = assign(part, pivots.value, radius)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(keys[at + rows], pa.int64()), pa.array(home, pa.bool_()),
                     pa.array(copies[at + rows], pa.int64()), pa.array([part[i].tobytes() for i in rows], pa.binary())],
                    names=["cell", "key", "home", "weight", "vector"])

    members = nodes.select("v", "key", "copies").mapInArrow(
        route, "cell long, key long, home boolean, weight long, vector binary")
    slack = np.float32(max(1e-4, 1e-6 * size))

    def close(a, b):
        """Pairs by a product in single precision that misses none, then each in double precision."""
        i, j = cells.where(a.astype(np.float32) @ b.astype(np.float32).T >= np.float32(least) - slack)
        exact = np.concatenate([np.einsum("ij,ij->i", a[i[at:at + 65536]], b[j[at:at + 65536]]) for at in range(0, len(i), 65536)] or [np.zeros(0)])
        return i[exact >= least], j[exact >= least]

    return cells.links(members, close, lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), np.float64).reshape(-1, size),
                       block_rows)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; the largest component is divided out first, so that no square over- or underflows."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True) if vectors.size else vectors
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def similar(df: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding",
            cell_rows: int = 8192, sample_rows: int = 4096, max_pivots: int = 256, block_rows: int = 4096) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row; rows link at a cosine of ``least`` or more.

    The cosine is computed in double precision.  ``n_links`` counts the other rows a row links with,
    ``component_id`` is the smallest vec_id that links reach, the row's own included, and ``kept`` says
    whether the row bears it.  A vector that is null, empty, zero or holds null or non-finite
    components links with nothing, and so does a row without vec_id (component null, not kept).  Vectors
    of different lengths are never compared.  Equal vectors are one node, however many rows share it.

    Pivots come from the ``sample_rows`` vectors of smallest hash (bounded; the answer does not
    depend on them), about one for ``cell_rows`` distinct vectors.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).withColumn(
        "v", F.when(_valid("v") & F.col("vec_id").isNotNull(), F.transform("v", lambda x: x + F.lit(0.0))))
    nodes = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("key"), F.count("*").alias("copies")), "vectors")
    parts = []
    for size in sorted(r[0] for r in nodes.select(F.size("v")).distinct().collect()):
        parts.append(_links(nodes.where(F.size("v") == size), size, least, cell_rows, sample_rows, max_pivots, block_rows))
    if not parts:
        empty = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        return empty.withColumn("kept", F.col("vec_id").isNotNull())
    found = parts[0]
    for part in parts[1:]:
        found = found.unionAll(part)
    found = stored(found, "links")
    counts = found.groupBy("key").agg(F.sum("n").alias("n"))
    named = cells.components(found.select("key", "root"), "key", "root")
    known = stored(nodes.join(counts, "key", "left").join(named, "key", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "key").alias("component_id")), "known")
    out = rows.join(known, "v", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                      F.coalesce("component_id", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
