"""Streaming operators driven over the driver tables as file streams."""

import os

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import table
from matchweave.sources.tables import shared_dir
from matchweave.streaming import live as L
from matchweave.streaming import state as T


def stream(spark, folder, name, order):
    """A driver table as a stream of four micro-batches in the order of a column."""
    by = F.col(order)
    rows = table(spark, folder, name)
    return L.ordered_log(rows, F.unix_micros(by) if rows.schema[order].dataType.typeName() == "timestamp" else by, name)


@query("stream_ingest_log", "SELECT event_id, user_id, event_type, value FROM events")
def stream_ingest_log(spark, folder):
    return L.run(stream(spark, folder, "events", "ts").select("event_id", "user_id", "event_type", "value"), "ingest")


@query("stream_live_counters", """
SELECT epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total,
  count(CASE WHEN value <= 5 THEN 1 END) AS le_5, count(CASE WHEN value <= 20 THEN 1 END) AS le_20, count(value) AS le_inf
FROM events GROUP BY ALL
""")
def stream_live_counters(spark, folder):
    live = L.live_counters(stream(spark, folder, "events", "ts"), ts="ts", label="event_type", value="value",
                           buckets=[5, 20], width="1 day")
    out = L.run(live, "counters", "update", ["window_start", "event_type"])
    return out.withColumns({"window_start": F.unix_seconds("window_start"), "total": F.round("total", 4)})


@query("stream_sessions", """
WITH marked AS (
  SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM marked)
SELECT user_id, epoch_us(min(ts)) // 1000 AS session_start, count(*) AS query_count FROM numbered GROUP BY user_id, s
""")
def stream_sessions(spark, folder):
    """Sessions still open at the end of the log are closed by running it to completion."""
    live = L.live_sessions(stream(spark, folder, "events", "ts"), ts="ts", client="user_id", gap="12 hours")
    out = L.run(live, "sessions", "complete", ["user_id", "session_start", "session_end"])
    return out.select("user_id", F.unix_millis("session_start").alias("session_start"), "query_count")


@query("stream_feedback_join", """
SELECT l_orderkey AS query_id, l_partkey AS item, l_linenumber AS position, l_quantity AS quantity, l_extendedprice AS price
FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 60 DAY
""")
def stream_feedback_join(spark, folder):
    searches = stream(spark, folder, "orders", "o_orderdate").select(
        F.col("o_orderkey").alias("query_id"), F.col("o_orderdate").alias("searched_at"))
    feedback = stream(spark, folder, "lineitem", "l_shipdate").select(
        F.col("l_orderkey").alias("fb_query_id"), F.col("l_shipdate").alias("fed_back_at"), F.col("l_partkey").alias("item"),
        F.col("l_linenumber").alias("position"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"))
    joined = L.join_feedback(searches, feedback, within="60 days")
    return L.run(joined.select("query_id", "item", "position", "quantity", "price"), "feedback")


@query("stream_suppress_repeats", """
WITH RECURSIVE instants AS (SELECT DISTINCT user_id, event_type, epoch_us(ts) // 1000 AS ms FROM events),
following AS (
  SELECT a.user_id, a.event_type, a.ms, min(b.ms) AS nxt FROM instants a
  LEFT JOIN instants b ON b.user_id = a.user_id AND b.event_type = a.event_type AND b.ms >= a.ms + 604800000 GROUP BY ALL),
kept AS (
  SELECT user_id, event_type, min(ms) AS ms FROM instants GROUP BY ALL
  UNION ALL SELECT k.user_id, k.event_type, f.nxt FROM kept k JOIN following f USING (user_id, event_type, ms) WHERE f.nxt IS NOT NULL)
SELECT user_id, event_type, count(*) AS kept FROM kept GROUP BY ALL
""")
def stream_suppress_repeats(spark, folder):
    """Requests that do not repeat one that was let through in the seven days before."""
    keyed = stream(spark, folder, "events", "ts").withColumn("k", F.concat_ws("|", "user_id", "event_type"))
    out = L.run(T.live_reuse(keyed, key="k", ts="ts", ttl_seconds=604800), "repeats").where(~F.col("hit"))
    parts = F.split("k", "[|]")
    return out.groupBy(parts[0].cast("bigint").alias("user_id"), parts[1].alias("event_type")).agg(F.count("*").alias("kept"))


_HELD = "event_id % 10 = 3 AND ts < (SELECT min(ts) + (max(ts) - min(ts)) / 2 FROM events)"


@query("stream_late_rows", f"""
WITH held AS (SELECT *, {_HELD} AS late FROM events),
edge AS (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY AS watermark FROM held WHERE NOT late),
judged AS (SELECT h.*, late AND ts <= watermark AS dropped FROM held h, edge)
SELECT event_type, count(*) FILTER (NOT dropped) AS n, (SELECT count(*) FROM judged WHERE dropped) AS n_dropped FROM judged GROUP BY event_type
""")
def stream_late_rows(spark, folder):
    """A tenth of the first half of the log comes after all else: what the watermark has passed is dropped and counted."""
    rows = table(spark, folder, "events")
    times = rows.agg((F.unix_micros(F.min("ts")) + (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 2).alias("m")).first().m
    late = (F.col("event_id") % 10 == 3) & (F.unix_micros("ts") < times)
    log = L.ordered_log(rows, F.unix_micros("ts"), "late", held_back=late)
    kept, progress = L.drive(L.without_repeats(log, ts="ts", keys=["event_id"]).select("event_id", "event_type", "ts"), "late")
    return kept.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("n_dropped", F.lit(L.dropped_rows(progress)).cast("bigint"))


@query("stream_rate_limit", """
WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events)
SELECT user_id, ms, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND 1 PRECEDING) < 5 AS allowed FROM e
""")
def stream_rate_limit(spark, folder):
    live = T.live_rate_limit(stream(spark, folder, "events", "ts"), client="user_id", ts="ts", limit=5, window_ms=86_400_000)
    return L.run(live, "rate")


@query("stream_result_reuse", """
WITH RECURSIVE instants AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events),
following AS (SELECT a.user_id, a.ms, min(b.ms) AS nxt FROM instants a LEFT JOIN instants b ON b.user_id = a.user_id AND b.ms >= a.ms + 259200000 GROUP BY ALL),
misses AS (
  SELECT user_id, min(ms) AS ms FROM instants GROUP BY 1
  UNION ALL SELECT m.user_id, f.nxt FROM misses m JOIN following f USING (user_id, ms) WHERE f.nxt IS NOT NULL)
SELECT user_id, count(*) AS requests, count(CASE WHEN hit THEN 1 END) AS hits FROM (
  SELECT user_id, ms, (user_id, ms) NOT IN (SELECT (user_id, ms) FROM misses) AS hit FROM instants) GROUP BY user_id
""")
def stream_result_reuse(spark, folder):
    out = L.run(T.live_reuse(stream(spark, folder, "events", "ts"), key="user_id", ts="ts", ttl_seconds=259200), "reuse")
    return out.groupBy("user_id").agg(F.count("*").alias("requests"), F.count(F.when(F.col("hit"), 1)).alias("hits"))


@query("stream_upsert", """
SELECT c_custkey, c_name, coalesce(price, c_acctbal) AS c_acctbal FROM customer
LEFT JOIN (SELECT o_custkey, max_by(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def stream_upsert(spark, folder):
    root = shared_dir(spark, "upsert")
    base = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    base.write.parquet(os.path.join(root, "snapshot=-1"))
    def snapshot(epoch):
        return spark.read.schema(base.schema).parquet(os.path.join(root, f"snapshot={epoch}"))

    def write_next(after, epoch):
        after.write.mode("overwrite").parquet(os.path.join(root, f"snapshot={epoch}"))

    changes = stream(spark, folder, "orders", "o_orderkey").select(
        F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("string").alias("c_name"),
        F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderkey").alias("_seq"))
    apply = L.upsert_batch(snapshot, write_next, key="c_custkey", refreshed=["c_acctbal"])
    run = (changes.writeStream.foreachBatch(apply).trigger(availableNow=True)
           .option("checkpointLocation", os.path.join(root, "checkpoint")).start())
    run.awaitTermination()
    return snapshot(run.lastProgress["batchId"])
