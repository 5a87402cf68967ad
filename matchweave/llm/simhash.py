"""SimHash fingerprints and their exact near pairs, found with vantage-point trees or by the values of bands of bits."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm import cells
from matchweave.llm.common import append, stored, texts_of

#: Shingles whose bits are counted at a time.
_STRIP = 1 << 16

#: Bits of a band that tell its cells, at least.
_LEAST_BITS = 8


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint as an unsigned integer; no words: zero."""
    parts = text.encode().lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(words, len(parts))
    spans = zip(starts[:len(parts) - width + 1].tolist(), ends[width - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], "<u8")
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _STRIP):
        bits = np.unpackbits(hashes[at:at + _STRIP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_in += bits.sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", words: int = 3) -> DataFrame:
    """``df`` with ``fingerprint`` (long, the 64 bits as a signed number) of each whole text.

    Lower case for A-Z, words between ASCII white space, shingles with repeats; a text with fewer
    words than a shingle has its whole sequence as one, a null text or one without words has zero.
    """
    def compute(batch):
        values = np.array([fingerprint(t, words) for t in texts_of(batch, text)], np.uint64)
        return [pa.array(values.view(np.int64))]

    return append(df, text, [T.StructField("fingerprint", T.LongType())], compute)


class VantageTree:
    """Shards of 64-bit fingerprints: each inner node has a vantage point and a radius.

    Distances are counted in the bits of ``mask``; they keep the triangle inequality.  A fingerprint within the radius has its home inside, any other outside.  By the triangle
    inequality one within ``reach`` of the border may have partners on the other side, and visits it.
    """

    def __init__(self, sample: np.ndarray, depth: float, reach: int, mask: int = (1 << 64) - 1):
        self.reach, self.mask, self.nodes, self.shards = reach, np.uint64(mask), [], 0
        self.root = self._grow(sample, round(2 ** depth))

    def _grow(self, sample: np.ndarray, shards: int) -> int:
        """Index of a node (vantage, radius, inside, outside) over at most ``shards``; a shard s is -1 - s.

        Each side gets its share of the shards, so their number follows the input without steps.
        """
        best = None
        if shards > 1 and len(sample) > 1:
            for vantage in sample[np.linspace(0, len(sample) - 1, 16).astype(int)]:
                distance = np.bitwise_count((sample ^ vantage) & self.mask)
                radius = int(np.median(distance))
                inside, border = (distance <= radius).mean(), (np.abs(distance - radius - 0.5) < self.reach).mean()
                if 0 < inside < 1 and (best is None or border + abs(inside - 0.5) < best[0]):
                    best = border + abs(inside - 0.5), vantage, radius, distance
        if best is None:
            self.shards += 1
            return -self.shards
        _, vantage, radius, distance = best
        at = len(self.nodes)
        self.nodes.append(None)
        share = min(shards - 1, max(1, round(shards * float((distance <= radius).mean()))))
        inside = self._grow(sample[distance <= radius], share)
        outside = self._grow(sample[distance > radius], shards - share)
        self.nodes[at] = (vantage, radius, inside, outside)
        return at

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards and whether at home there; a row visits only shards after its home.

        A pair within ``reach`` meets in the later of its two homes: the earlier one visits it.
        """
        found = []
        todo = [(self.root, np.arange(len(values)), np.ones(len(values), bool))]
        while todo:
            node, rows, home = todo.pop()
            if node < 0:
                found.append((rows, np.full(len(rows), -1 - node), home))
                continue
            vantage, radius, inside, outside = self.nodes[node]
            distance = np.bitwise_count((values[rows] ^ vantage) & self.mask).astype(np.int64)
            for child, here, near in ((inside, distance <= radius, distance <= radius + self.reach),
                                      (outside, distance > radius, distance + self.reach > radius)):
                if near.any():
                    todo.append((child, rows[near], (home & here)[near]))
        rows, shards, home = (np.concatenate(x) for x in zip(*found))
        own = np.zeros(len(values), np.int64)
        own[rows[home]] = shards[home]
        keep = home | (shards > own[rows])
        return rows[keep], shards[keep], home[keep]


def grove(sample: np.ndarray, depth: float, reach: int, bands: int) -> list[VantageTree]:
    """A tree for each of ``bands`` bands of the 64 bits.

    Of two fingerprints within ``reach`` bits, some band holds at most ``reach // bands`` of the bits
    that differ, so they meet in that band's tree.  Its borders are that much narrower, which copies
    far fewer fingerprints than one tree over all bits does.
    """
    edges = [64 * i // bands for i in range(bands + 1)]
    return [VantageTree(sample, depth, reach // bands, (1 << high) - (1 << low)) for low, high in zip(edges, edges[1:])]


class BandValues:
    """Shards of 64-bit fingerprints: the values of ``bits`` bits from ``low`` on.

    A fingerprint has its home at its own value and visits each later value that differs in at most ``flips`` bits.
    How many it visits depends on ``bits`` and ``flips`` only, not on how the fingerprints lie.
    """

    def __init__(self, low: int, bits: int, flips: int):
        self.low, self.shards = np.uint64(low), 1 << bits
        self.masks = np.array([sum(1 << p for p in flipped) for n in range(flips + 1)
                               for flipped in itertools.combinations(range(bits), n)], np.int64)

    def route(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shards and whether at home there; of two values that are near, the smaller visits the larger."""
        own = ((values >> self.low) & np.uint64(self.shards - 1)).astype(np.int64)[:, None]
        met = own ^ self.masks
        rows, at = cells.where(met >= own)
        return rows, met[rows, at], at == 0


def band_values(n: int, reach: int, bands: int, shard_rows: int) -> list[BandValues]:
    """The shards of each of ``bands`` bands of the 64 bits, of ``shard_rows`` or fewer of ``n`` fingerprints spread evenly.

    The flips of all bands and their number add up to ``reach + 1``, so of two fingerprints within
    ``reach`` bits some band holds at most its flips of the bits that differ, and they meet there.
    The bits used grow with the logarithm of ``n``, from 8 to the width of a band.
    """
    bands = min(bands, reach + 1)
    flips, wider = divmod(reach + 1 - bands, bands)
    bits = min(64 // bands, max(_LEAST_BITS, math.ceil(math.log2(max(1, n) / shard_rows))))
    return [BandValues(64 * i // bands, bits, flips + (i < wider)) for i in range(bands)]


def routed(distinct: DataFrame, reach: int, shard_rows: int = 4096, sample_rows: int = 8192, max_depth: int = 10,
           bands: int = 2, flip: bool = False) -> DataFrame:
    """(cell, key, home) of the distinct fingerprints ``key``: any two within ``reach`` bits meet in some cell.

    With ``flip`` the cells are those of ``band_values``.  Else they are the shards of trees, grown on the
    ``sample_rows`` fingerprints with the smallest hashes (a bounded sample; what meets does not depend on
    it) until a shard should hold ``shard_rows``, at most 2**max_depth shards each.  Trees copy less at a
    small reach; at a wide one nearly all fingerprints visit nearly all shards, and values copy less.
    """
    spark = distinct.sparkSession
    if flip:
        shards = band_values(distinct.count(), reach, bands, shard_rows)
    else:
        sample = [r[0] for r in distinct.orderBy(F.xxhash64("key", F.lit("vantage"))).limit(sample_rows).collect()]
        depth = min(max_depth, max(0.0, math.log2(max(1, distinct.count()) / shard_rows)))
        shards = grove(np.array(sample, np.int64).view(np.uint64), depth, reach, bands)
    trees = spark.sparkContext.broadcast(shards)

    def route(batches):
        for batch in batches:
            keys, first = batch.column("key").to_numpy(), 0
            for tree in trees.value if len(keys) else ():
                rows, shards, home = tree.route(keys.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shards + first, pa.int64()), pa.array(keys[rows], pa.int64()), pa.array(home, pa.bool_())],
                    names=["cell", "key", "home"])
                first += tree.shards

    return distinct.select("key").mapInArrow(route, "cell long, key long, home boolean")


def near_components(distinct: DataFrame, reach: int, block_rows: int = 4096, **options) -> DataFrame:
    """(key, component) of the distinct fingerprints ``key`` that have another within ``reach`` bits.

    All fingerprints are ``routed``, with its ``options``, and pairs that meet are compared in all 64 bits.
    """
    def close(a, b):
        return cells.where(np.bitwise_count(a[:, None] ^ b[None, :]) <= reach)

    found = cells.links(routed(distinct, reach, **options), close, lambda t: t.column("key").to_numpy().view(np.uint64), block_rows)
    return cells.components(found.select("key", "root"), "key", "root")


def _grouped(df: DataFrame, reach: int, words: int, doc_id: str, text: str, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, fingerprint), the group of each fingerprint, and the first row of each group.

    Rows come in the order of doc_id, a null one last, and then of the hash of their text.
    """
    marked = fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", words)
    rows = stored(marked.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "fingerprint"), "fingerprints")
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_hash")).alias("first")
    distinct = stored(rows.groupBy(F.col("fingerprint").alias("key")).agg(first), "distinct")
    named = near_components(distinct.select("key"), reach, **options)
    groups = stored(distinct.join(named, "key", "left").select("key", "first", F.coalesce("component", "key").alias("group")), "groups")
    return rows, groups, stored(groups.groupBy("group").agg(F.min("first").alias("first")), "first")


def near_duplicates(df: DataFrame, reach: int = 3, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints link at ``reach`` or fewer bits.

    ``fingerprint`` is 16 hex digits, ``component_id`` the smallest doc_id that links reach.  Equal
    fingerprints, zero among them, are one node, however many rows share it; repeated rows stay.  A
    null doc_id is never the smallest unless all of its component are null.
    """
    rows, groups, first = _grouped(df, reach, words, doc_id, text)
    ids = stored(groups.select("key", "group").join(first, "group").select(
        F.col("key").alias("fingerprint"), F.col("first.doc_id").alias("component_id")), "ids")
    return rows.join(ids, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, reach: int = 3, words: int = 3, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with one row for each component: that of the smallest doc_id, a null one last.

    Of rows that share doc_id and text one stays.  ``options`` are those of ``near_components``.
    """
    _, _, first = _grouped(df, reach, words, doc_id, text, **options)
    named, hashed = "__doc", "__text"
    none = F.lit(-(1 << 63))
    keep = first.select(F.coalesce(F.col("first.doc_id"), none).alias(named), F.col("first.text_hash").alias(hashed))
    marked = df.withColumns({named: F.coalesce(F.col(doc_id), none), hashed: F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    return marked.join(keep, [named, hashed], "left_semi").dropDuplicates([named, hashed]).select(*df.columns)
