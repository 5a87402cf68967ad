"""Request-log operators with a moving or resetting time bound: rate limit and result reuse.

A client or a repeated request may own a large share of the log, so nothing is grouped by
that key alone: equal times are counted first, and each task sees one key in one stretch of
time, whose size is bounded by the number of distinct milliseconds in it.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.session import ship
from matchweave.sources.tables import materialize

GRANULE_MS = 60_000
# Rows that a task should handle at a time, and stretches of a key that are composed in one step.
BUCKET_ROWS, FAN = 50_000, 64
NEVER = -(2 ** 62)


def by_instant(requests: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ms, requests): requests per key and millisecond."""
    return requests.groupBy(key, F.unix_millis(F.col(ts).cast("timestamp")).alias("ms")).agg(
        F.count("*").alias("requests"))


def rate_limit(requests: DataFrame, *, client: str = "client", ts: str = "ts",
               limit: int = vocab.RATE_LIMIT, window_ms: int = vocab.RATE_WINDOW_MS) -> DataFrame:
    """(client, ms, requests, prior, allowed, denied) of a sliding-window limiter.

    A request is allowed if fewer than ``limit`` distinct earlier milliseconds of its client lie
    inside the window; denied requests count too.  Further requests of the same millisecond see
    that millisecond as well.

    The window is put together from one-minute granules: the entries before the request in its
    own granule, whole granules in between, and the entries of the oldest granule that are
    still inside.
    """
    granule = min(window_ms, GRANULE_MS)
    if window_ms % granule:
        raise ValueError(f"window_ms must be a multiple of {granule}")
    span = window_ms // granule
    instants = by_instant(requests, client, ts)
    g = F.floor(F.col("ms") / granule)
    # Each instant appears in its own granule and in the one it is last visible from.
    places = F.array(F.struct(g.alias("_g"), F.lit(1).alias("_own")),
                     F.struct((g + span).alias("_g"), F.lit(0).alias("_own")))
    both = instants.select(client, "ms", "requests", F.inline(places)).withColumn(
        "_offset", F.pmod("ms", F.lit(granule)))
    cell = Window.partitionBy(client, "_g")
    before = cell.orderBy("_offset").rangeBetween(Window.unboundedPreceding, -1)
    after = cell.orderBy("_offset").rangeBetween(1, Window.unboundedFollowing)
    near = both.withColumn("_near", F.count(F.when(F.col("_own") == 1, 1)).over(before)
                           + F.count(F.when(F.col("_own") == 0, 1)).over(after)).where("_own = 1")
    if span > 1:
        sizes = instants.groupBy(client, g.alias("_g")).agg(F.count("*").alias("_n"))
        middle = Window.partitionBy(client).orderBy("_g").rangeBetween(-(span - 1), -1)
        sizes = sizes.select(client, "_g", F.coalesce(F.sum("_n").over(middle), F.lit(0)).alias("_mid"))
        near = near.join(sizes, [client, "_g"])
    else:
        near = near.withColumn("_mid", F.lit(0))
    prior = F.col("_near") + F.col("_mid")
    first = F.when(prior < limit, 1).otherwise(0)
    later = F.when(prior + 1 < limit, F.col("requests") - 1).otherwise(0)
    return near.select(client, "ms", "requests", prior.alias("prior"),
                       (first + later).cast("bigint").alias("allowed"),
                       (F.col("requests") - first - later).cast("bigint").alias("denied"))


# ---------------------------------------------------------------- result reuse
def _starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins."""
    new = np.zeros(len(frame), dtype=bool)
    new[:1] = True
    for key in keys:
        values = frame[key].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.flatnonzero(new)


class _Timeline:
    """Several groups of sorted times on one axis, far enough apart not to meet."""

    def __init__(self, frame: pd.DataFrame, keys: list[str], ttl: int, stretch: int):
        self.starts = _starts(frame, keys)
        sizes = np.diff(np.append(self.starts, len(frame)))
        self.group = np.repeat(np.arange(len(self.starts)), sizes)
        self.gap = stretch + 4 * ttl
        self.origin = frame["_s"].to_numpy() * stretch
        self.offset = frame["ms"].to_numpy() - self.origin
        self.axis = self.group * self.gap + self.offset
        # First later row a request at this row does not serve; its own row if there is none.
        after = np.searchsorted(self.axis, self.axis + ttl)
        inside = after < len(frame)
        inside[inside] = self.group[after[inside]] == self.group[inside]
        self.has_next = inside
        self.next = np.where(inside, after, np.arange(len(frame)))


def _steps(frame: pd.DataFrame, key: str, ttl: int, stretch: int) -> pd.DataFrame:
    """The function of each stretch from the expiry it starts with to the one it ends with: rows (_upto, _out).

    An expiry up to ``_upto`` and over the step before leads to ``_out``; one over all steps stays.
    """
    line = _Timeline(frame, [key, "_s"], ttl, stretch)
    end = line.next
    while not np.array_equal(end, end[end]):  # follow every chain to its last miss
        end = end[end]
    out = frame["ms"].to_numpy()[end] + ttl
    # An expiry from before ends inside the first lifetime, so only its requests and
    # the first one after it can start a chain.
    early = line.offset < ttl
    before = np.append(True, early[:-1])
    before[line.starts] = True
    entry = np.flatnonzero(early | before)
    last = np.append((line.group[entry][1:] != line.group[entry][:-1])
                     | (out[entry][1:] != out[entry][:-1]), True)
    keep = entry[last]
    return pd.DataFrame({key: frame[key].to_numpy()[keep], "_t": frame["_s"].to_numpy()[keep],
                         "_upto": frame["ms"].to_numpy()[keep], "_out": out[keep]})


def _stretches(frame: pd.DataFrame, key: str):
    """For each key and block (``_above``) of a sorted frame: its rows, and each stretch (number, upto, out) in order."""
    upto, out = frame["_upto"].to_numpy(), frame["_out"].to_numpy()
    number, inner = frame["_t"].to_numpy(), _starts(frame, [key, "_above", "_t"])
    outer = _starts(frame, [key, "_above"])
    for a, b in zip(outer, np.append(outer[1:], len(frame))):
        first = inner[np.searchsorted(inner, a):np.searchsorted(inner, b)]
        yield a, [(number[i], upto[i:j], out[i:j]) for i, j in zip(first, np.append(first[1:], b))]


def _through(values: np.ndarray, upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The function of a stretch at several expiries."""
    at = np.searchsorted(upto, values)
    return np.where(at < len(out), out[np.minimum(at, len(out) - 1)], values)


def _composed(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    """The functions of blocks from those of their stretches.

    An expiry that is over all steps of a block's first stretch meets the first step of the second one, as
    a stretch is longer than a lifetime.
    """
    parts = []
    for a, stretches in _stretches(frame, key):
        (_, upto, out), rest = stretches[0], stretches[1:]
        if rest:
            upto, out = np.append(upto, rest[0][1][0]), np.append(_through(out, *rest[0][1:]), rest[0][2][0])
        for _, more, leads in rest[1:]:
            out = _through(out, more, leads)
        keep = np.append(out[1:] != out[:-1], True)
        parts.append(pd.DataFrame({key: [frame[key].iloc[a]] * keep.sum(), "_t": frame["_above"].iloc[a], "_upto": upto[keep], "_out": out[keep]}))
    return pd.concat(parts) if parts else frame[[key, "_t", "_upto", "_out"]]


def _entries(frame: pd.DataFrame, key: str) -> pd.DataFrame:
    """The expiry that each stretch starts with, from that of its block (``_in``)."""
    rows = []
    for a, stretches in _stretches(frame, key):
        now = frame["_in"].to_numpy()[a:a + 1]
        for number, upto, out in stretches:
            rows.append((frame[key].iloc[a], number, int(now[0])))
            now = _through(now, upto, out)
    return pd.DataFrame(rows, columns=[key, "_t", "_in"])


def _marked(frame: pd.DataFrame, key: str, ttl: int, stretch: int) -> pd.DataFrame:
    """The misses of each stretch from the expiry it starts with."""
    line = _Timeline(frame, [key, "_s"], ttl, stretch)
    misses = np.zeros(len(frame), dtype=np.int64)
    entry = np.clip(frame["_in"].to_numpy()[line.starts] - line.origin[line.starts], 0, stretch + ttl)
    row = np.searchsorted(line.axis, np.arange(len(line.starts)) * line.gap + entry)
    ok = row < len(frame)
    ok[ok] = line.group[row[ok]] == np.flatnonzero(ok)
    row = row[ok]
    while len(row):
        misses[row] = 1
        row = line.next[row[line.has_next[row]]]
    return frame[[key, "ms", "requests"]].assign(misses=misses, hits=frame["requests"] - misses)


def result_reuse(requests: DataFrame, *, key: str = "request_key", ts: str = "ts",
                 ttl_seconds: int = vocab.CACHE_TTL_SECONDS, stretch_ttls: int = 96, fan: int = FAN,
                 bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(key, ms, requests, misses, hits): a request hits if it is within the time to live of the
    last miss; a hit does not extend it.

    Which requests miss depends on the miss before, so the log is cut into stretches of
    ``stretch_ttls`` lifetimes.  Each stretch is reduced to the steps of its expiry-in to expiry-out function.
    Functions of ``fan`` stretches are composed to that of a block, those of ``fan`` blocks to the next, until one
    block holds all time; on the way back each block, and at last each stretch, gets the expiry it starts with,
    and marks its misses.  All of it is dealt by key and block, so one client with all
    requests is as many tasks as its log has blocks.
    """
    ship()
    ttl = ttl_seconds * 1000
    stretch = ttl * stretch_ttls
    span = requests.agg(F.count("*").alias("n"), *[f(F.unix_millis(F.col(ts).cast("timestamp"))) for f in (F.min, F.max)]).first()
    buckets = max(requests.sparkSession.sparkContext.defaultParallelism, math.ceil(span[0] / bucket_rows))
    instants = by_instant(requests, key, ts).withColumn("_s", F.floor(F.col("ms") / stretch))
    kind = instants.schema[key].dataType.simpleString()

    def dealt(df: DataFrame, group: list[str], compute, schema: str) -> DataFrame:
        """``compute`` of frames of whole groups, sorted by all columns from the group's on."""
        names = [c for c in df.columns if c != "_b"]
        order = [*group, *[c for c in ("_t", "_upto", "ms") if c in names and c not in group]]
        rows = df.withColumn("_b", F.pmod(F.xxhash64(*group), F.lit(buckets)))
        return rows.groupBy("_b").applyInPandas(lambda frame: compute(frame.sort_values(order, ignore_index=True)), schema)

    steps = f"{key} {kind}, _t bigint, _upto bigint, _out bigint"
    levels = [dealt(instants, [key, "_s"], lambda f: _steps(f, key, ttl, stretch), steps)]
    blocks = 0 if span[1] is None else span[2] // stretch - span[1] // stretch + 1
    first = 0 if span[1] is None else span[1] // stretch
    above = lambda df, first: df.withColumn("_above", F.floor((F.col("_t") - first) / fan))
    while blocks > fan:
        levels[-1] = materialize(levels[-1], "steps")
        levels.append(dealt(above(levels[-1], first), [key, "_above"], lambda f: _composed(f, key), steps))
        blocks, first = math.ceil(blocks / fan), 0
    starts = None
    for level in reversed(range(len(levels))):
        inside = above(levels[level], 0 if level or span[1] is None else span[1] // stretch)
        if starts is None:
            inside = inside.withColumn("_in", F.lit(NEVER))
        else:
            inside = inside.join(starts.withColumnRenamed("_t", "_above"), [key, "_above"])
        starts = dealt(inside, [key, "_above"], lambda f: _entries(f, key), f"{key} {kind}, _t bigint, _in bigint")
    return dealt(instants.join(starts.withColumnRenamed("_t", "_s"), [key, "_s"]), [key, "_s"],
                 lambda f: _marked(f, key, ttl, stretch), f"{key} {kind}, ms bigint, requests bigint, misses bigint, hits bigint")
