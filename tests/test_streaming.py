"""Streams over several micro-batches end where the batch operators do."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchweave.operators.traffic import rate_limit, result_reuse
from matchweave.sources.tables import FEEDBACK_SCHEMA
from matchweave.streaming import live as L
from matchweave.streaming import state as T

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "client string, ts timestamp, status string, ms double"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def write(spark, path, batches):
    """One file per micro-batch, read in the order written."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return L.read_log(spark, path, spark.createDataFrame([], SCHEMA).schema, ts="ts", max_files=1)


BATCHES = [[("a", at(m), "ok", 10.0 * m) for m in range(0, 20, 2)] + [("b", at(3), "bad", 70.0)],
           [("a", at(m), "ok", 30.0) for m in range(20, 40, 2)], [("b", at(41), "ok", 500.0)]]


def test_ingest(spark, tmp_path):
    write(spark, str(tmp_path / "log"), BATCHES)
    assert L.run(stream(spark, str(tmp_path / "log")), "t").count() == 22


def test_counters_match_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, BATCHES)
    out = L.run(L.live_counters(stream(spark, path), ts="ts", label="status", value="ms", buckets=[50, 100], width="10 minutes"),
                "c", "update", ["window_start", "status"])
    batch = spark.read.parquet(path).groupBy(F.window("ts", "10 minutes").start.alias("window_start"), "status").agg(
        F.count("*").alias("n"), F.sum("ms").alias("total"), F.count(F.when(F.col("ms") <= 50, 1)).alias("le_50"),
        F.count(F.when(F.col("ms") <= 100, 1)).alias("le_100"), F.count("ms").alias("le_inf"))
    assert sorted(map(tuple, out.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))


def test_late_rows_are_dropped(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [[("a", at(60), "ok", 1.0)], [("a", at(62), "ok", 1.0)], [("a", at(1), "late", 1.0), ("a", at(63), "ok", 1.0)]])
    out = L.run(L.live_counters(stream(spark, path), ts="ts", label="status", value="ms", buckets=[5], width="5 minutes",
                                delay="10 minutes"), "late", "update", ["window_start", "status"])
    assert {r.status for r in out.collect()} == {"ok"} and out.agg(F.sum("n")).first()[0] == 3


def test_ordered_log_and_counted_late_rows(spark):
    rows = [(i, at(i * 10), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, k int").repartition(3)
    late = F.col("id").isin(5, 6, 350)
    log = L.ordered_log(df, F.unix_micros("ts"), "t", parts=4, held_back=late)
    kept, progress = L.drive(L.without_repeats(log, ts="ts", keys=["id"], delay="10 hours"), "t")
    assert L.batches(progress) == 5 and L.dropped_rows(progress) == 2
    assert sorted(r.id for r in kept.collect()) == [i for i in range(400) if i not in (5, 6)]
    sums, progress = L.drive(L.live_sessions(L.ordered_log(df, F.unix_micros("ts"), "u"), ts="ts", client="k", gap="45 minutes"), "u", "complete")
    assert L.batches(progress) == 4 and sums.agg(F.sum("query_count")).first()[0] == 400 and sums.count() == 3


def test_sessions(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [[("a", at(0), "", 0.0), ("a", at(10), "", 0.0)], [("a", at(15), "", 0.0), ("a", at(90), "", 0.0)]])
    out = L.run(L.live_sessions(stream(spark, path), ts="ts", client="client", delay="2 hours"), "s", "complete",
                ["client", "session_start", "session_end"])
    assert sorted((r.session_start.minute + 60 * r.session_start.hour, r.query_count) for r in out.collect()) == [(0, 3), (90, 1)]


def test_replayed_epoch_of_upsert_changes_nothing(spark):
    base = spark.createDataFrame([(1, 10.0), (2, 20.0)], "id long, fee double")
    kept = {-1: base}
    apply = L.upsert_batch(kept.__getitem__, lambda after, epoch: kept.__setitem__(epoch, after), key="id", refreshed=["fee"])
    for epoch, fee in ((0, 11.0), (1, 12.0), (1, 12.0)):
        apply(spark.createDataFrame([(1, fee, epoch)], "id long, fee double, _seq long"), epoch)
    assert sorted(map(tuple, kept[1].collect())) == [(1, 12.0), (2, 20.0)]


def test_feedback_join_bound(spark, tmp_path):
    for name, rows, schema in (
            ("s", [("q1", at(0)), ("q2", at(0))], "query_id string, searched_at timestamp"),
            ("f", [("q1", at(30)), ("q1", at(61)), ("q2", at(-1))], "fb_query_id string, fed_back_at timestamp")):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name))
    s, f = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in "sf"]
    rows = L.run(L.join_feedback(s, f, within="1 hour").select("query_id", "fed_back_at"), "j").collect()
    assert [(r.query_id, r.fed_back_at.minute) for r in rows] == [("q1", 30)]


def test_repeats_are_suppressed(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, BATCHES)
    assert L.run(L.suppress_repeats(stream(spark, path), ts="ts", key="client"), "r").count() <= 3


@pytest.mark.parametrize("limit", [3, 7])
def test_rate_limit_matches_batch(spark, tmp_path, limit):
    path = str(tmp_path / "log")
    write(spark, path, BATCHES)
    live = L.run(T.live_rate_limit(stream(spark, path), client="client", ts="ts", limit=limit, window_ms=600_000), "rl")
    batch = rate_limit(spark.read.parquet(path), client="client", ts="ts", limit=limit, window_ms=600_000)
    assert sorted((r.client, r.ms, r.allowed) for r in live.collect()) == sorted(
        (r.client, r.ms, bool(r.allowed)) for r in batch.collect())


def test_reuse_matches_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, BATCHES)
    live = L.run(T.live_reuse(stream(spark, path), key="client", ts="ts", ttl_seconds=300), "re")
    batch = result_reuse(spark.read.parquet(path), key="client", ts="ts", ttl_seconds=300)
    assert sorted((r.client, r.ms, r.hit) for r in live.collect()) == sorted(
        (r.client, r.ms, bool(r.hits)) for r in batch.collect())


def test_late_requests_and_expiry_of_state(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [[("a", at(0), "", 0.0), ("a", at(8), "", 0.0), ("c", at(0), "", 0.0)], [("a", at(4), "", 0.0)], [("a", at(9), "", 0.0)],
                        [("b", at(60), "", 0.0)], [("a", at(61), "", 0.0)], [("a", at(20), "", 0.0), ("b", None, "", 0.0)]])
    minutes = lambda ms: (ms - int(START.timestamp() * 1000)) // 60_000
    live = L.run(T.live_rate_limit(stream(spark, path), client="client", ts="ts", limit=2, window_ms=600_000), "late-rate")
    assert sorted((r.client, minutes(r.ms), r.allowed) for r in live.collect()) == [
        ("a", 0, True), ("a", 4, True), ("a", 8, True), ("a", 9, False), ("a", 61, True), ("b", 60, True), ("c", 0, True)]
    live = L.run(T.live_reuse(stream(spark, path), key="client", ts="ts", ttl_seconds=300), "late-reuse")
    assert sorted((r.client, minutes(r.ms), r.hit) for r in live.collect()) == [
        ("a", 0, False), ("a", 4, False), ("a", 8, False), ("a", 9, True), ("a", 61, False), ("b", 60, False), ("c", 0, False)]

    live = T.live_rate_limit(stream(spark, path), client="client", ts="ts", limit=2, window_ms=600_000)
    run = live.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    keys = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress]
    assert max(keys) == 3 and keys[-1] == 2  # c has expired


def test_feedback_log_stream(spark, tmp_path):
    spark.createDataFrame([("f", "q", "t", 5, 1, "explicit", None, None, START)], FEEDBACK_SCHEMA).write.parquet(str(tmp_path / "f"))
    assert L.run(L.read_log(spark, str(tmp_path / "f"), FEEDBACK_SCHEMA), "fb").first().rating == 5


def test_a_call_serves_many_keys():
    """Reading and writing the state once a call, whatever the number of keys; what the watermark has passed goes."""
    class State:
        held, calls = None, 0

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, value):
            self.held, self.calls = value, self.calls + 1

        def clear(self):
            self.held = None

    class Handle:
        timers: list = []
        getValueState = lambda self, *a: State()
        listTimers = lambda self: iter(self.timers)
        deleteTimer = lambda self, ms: self.timers.remove(ms)
        registerTimer = lambda self, ms: self.timers.append(ms)

    class Times:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    processor = T._Reuse(100)
    processor.init(Handle())
    rows = pd.DataFrame({"key": [f"k{i % 50}" for i in range(100)] + [None], "ms": [*range(100), 7]})
    out = pd.concat(processor.handleInputRows((1,), iter([rows]), Times(0)))
    assert out["answer"].sum() == 50 and processor.state.calls == 1 and len(processor.state.held[0]) == 51
    list(processor.handleInputRows((1,), iter([pd.DataFrame({"key": ["k3"], "ms": [140]})]), Times(130)))
    assert sorted(processor.state.held[0]) == sorted([*(f"k{i}" for i in range(31, 50)), "k3"]) and processor.handle.timers == [240]


def test_numeric_and_null_keys_keep_their_type(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(None if i % 7 == 0 else (1 << 60) + i % 7, at(i)) for i in range(20)]
    spark.createDataFrame(rows, "user long, ts timestamp").write.parquet(path)
    log = L.read_log(spark, path, "user long, ts timestamp", "ts")
    got = L.run(T.live_reuse(log, key="user", ts="ts", ttl_seconds=480), "typed")
    assert got.schema["user"].dataType.simpleString() == "bigint"
    assert sorted((r.user or 0, r.n) for r in got.where("not hit").groupBy("user").agg(F.count("*").alias("n")).collect()) == [
        (0, 2)] + [((1 << 60) + u, 2 if u <= 5 else 1) for u in range(1, 7)]
