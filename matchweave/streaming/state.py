"""Exact stateful stream operators: sliding-window rate limit and non-refreshing reuse.

State per key is small: the distinct milliseconds of the last window and delay, or one entry.  Event
time rules it: a timer clears a key's state once the watermark has passed all that it could decide.
Rows of a micro-batch are handled in time order; rows of an earlier time that come in a later
micro-batch are answered by event time, up to the delay; rows later than that are dropped from the
micro-batch on that follows the one whose watermark passed them.  Rows without a time belong to no window and are left out.  Bound micro-batches at the source
(``maxFilesPerTrigger`` or an offsets limit).  Both need the RocksDB state store.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from matchweave import vocab
from matchweave.session import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


#: Groups that keys are dealt to.  A call costs several exchanges with the state store, so it serves many keys.
BUCKETS = 1024


class _Expiring(StatefulProcessor):
    """A processor whose state for a key is cleared when the watermark reaches the key's expiry.

    It is called by bucket of keys.  The state of a bucket is a table (key, ms), read and written once a call; what the
    watermark has passed is left out when it is written, and a timer clears the state of a bucket that gets no more rows.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "keys array<string>, ms array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("ms", kind="stable")
        held: dict[str | None, list[int]] = {}
        if self.state.exists():
            for name, ms in zip(*self.state.get()):
                held.setdefault(name, []).append(int(ms))
        names, times = batch["key"].tolist(), batch["ms"].tolist()
        answers = [self.answer(held.setdefault(name, []), ms) for name, ms in zip(names, times)]
        passed = timerValues.getCurrentWatermarkInMs()
        for name in set(names):
            self.trim(held[name])
        held = {name: ms for name, ms in held.items() if self.expiry(ms) > passed}
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held:
            self.state.update(([name for name, ms in held.items() for _ in ms], [t for ms in held.values() for t in ms]))
            self.handle.registerTimer(max(map(self.expiry, held.values())))
        else:
            self.state.clear()
        yield pd.DataFrame({"key": pd.Series(names, dtype=object), "ms": times, "answer": answers})

    def trim(self, held: list[int]) -> None:
        """Drop what no row within the delay can need."""

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter([])

    def close(self) -> None:
        pass


class _RateLimiter(_Expiring):
    """Holds the distinct milliseconds of a key's requests in the last window and delay, ascending."""

    def __init__(self, limit: int, window_ms: int, delay_ms: int):
        self.limit, self.window, self.delay = limit, window_ms, delay_ms

    def answer(self, held: list[int], ms: int) -> bool:
        known = bisect_right(held, ms)
        allowed = known - bisect_right(held, ms - self.window) < self.limit
        if not known or held[known - 1] != ms:
            held.insert(known, ms)
        return allowed

    def trim(self, held: list[int]) -> None:
        del held[:bisect_right(held, held[-1] - self.delay - self.window)]

    def expiry(self, held: list[int]) -> int:
        return held[-1] + self.window


class _Reuse(_Expiring):
    """Holds when a key's entry expires."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def answer(self, held: list[int], ms: int) -> bool:
        hit = bool(held) and held[0] - self.ttl <= ms < held[0]
        if not held or ms >= held[0]:
            held[:] = [ms + self.ttl]
        return hit

    def expiry(self, held: list[int]) -> int:
        return held[0]


def _stateful(stream: DataFrame, key: str, ts: str, delay_seconds: int, processor: StatefulProcessor, answer: str) -> DataFrame:
    use_rocksdb(stream.sparkSession)
    ship()
    kind = stream.schema[key].dataType
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).where(F.col(ts).isNotNull())
    rows = timed.withWatermark(ts, f"{delay_seconds} seconds").select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.col(key).cast("string").alias("key"), ts, F.unix_millis(ts).alias("ms"))
    out = rows.groupBy("bucket").transformWithStateInPandas(
        processor, "key string, ms bigint, answer boolean", outputMode="Append", timeMode="EventTime")
    return out.select(F.col("key").cast(kind).alias(key), "ms", F.col("answer").alias(answer))


def live_rate_limit(stream: DataFrame, *, client: str, ts: str, limit: int = vocab.RATE_LIMIT,
                    window_ms: int = vocab.RATE_WINDOW_MS, delay_seconds: int = 600) -> DataFrame:
    """(client, ms, allowed) per request; one that comes late sees the requests before it, not those after."""
    return _stateful(stream, client, ts, delay_seconds, _RateLimiter(limit, window_ms, delay_seconds * 1000), "allowed")


def live_reuse(stream: DataFrame, *, key: str, ts: str,
               ttl_seconds: int = vocab.CACHE_TTL_SECONDS, delay_seconds: int = 600) -> DataFrame:
    """(key, ms, hit) per request; one that comes late and is older than the entry is a miss and leaves the entry."""
    return _stateful(stream, key, ts, delay_seconds, _Reuse(ttl_seconds * 1000), "hit")
