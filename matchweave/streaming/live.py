"""Structured Streaming versions of the log operators.

Functions take and return streaming frames, so the caller picks source, trigger and sink;
``run`` drives a stream over what is available and keeps its output as parquet.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.hist import bucket_columns
from matchweave.operators.changes import upsert
from matchweave.sources.tables import shared_dir


def read_log(spark: SparkSession, path: str, schema, ts: str = "created_at",
             max_files: int | None = None) -> DataFrame:
    """Parquet files of a log folder as a stream, event time as a zoned timestamp."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    stream = reader.parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


# ---------------------------------------------------------------- transformations
def live_counters(stream: DataFrame, *, ts: str, label: str, value: str,
                  buckets: Sequence[float] = vocab.LATENCY_BUCKETS, width: str = "5 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """Per window and label: count, sum, and cumulative histogram counts of ``value``."""
    return (stream.withWatermark(ts, delay).groupBy(F.window(ts, width), label)
            .agg(F.count("*").alias("n"), F.sum(value).alias("total"),
                 *bucket_columns(F.col(value), buckets))
            .withColumn("window_start", F.col("window.start")).drop("window"))


def live_sessions(stream: DataFrame, *, ts: str, client: str, gap: str = "30 minutes",
                  delay: str = "10 minutes") -> DataFrame:
    """Requests per session, a session ending after ``gap`` of silence."""
    return (stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap), client)
            .agg(F.count("*").alias("query_count"))
            .select(client, F.col("session_window.start").alias("session_start"),
                    F.col("session_window.end").alias("session_end"), "query_count"))


def join_feedback(searches: DataFrame, feedback: DataFrame, *, within: str = "1 hour",
                  delay: str = "10 minutes", how: str = "inner") -> DataFrame:
    """Feedback joined to its search if it came within a bound; both sides' state expires.

    ``searches`` (query_id, searched_at, ...), ``feedback`` (fb_query_id, fed_back_at, ...).
    """
    s = searches.withWatermark("searched_at", delay)
    f = feedback.withWatermark("fed_back_at", delay)
    bound = (F.col("query_id") == F.col("fb_query_id")) & (
        F.col("fed_back_at") >= F.col("searched_at")) & (
        F.col("fed_back_at") <= F.col("searched_at") + F.expr(f"INTERVAL {within}"))
    return s.join(f, bound, how)


def suppress_repeats(stream: DataFrame, *, ts: str, key: str, ttl: str = "1 hour") -> DataFrame:
    """Drop repeats of a request inside the watermark (coarse: a whole micro-batch counts as one)."""
    return stream.withWatermark(ts, ttl).dropDuplicatesWithinWatermark([key])


def upsert_batch(read_snapshot: Callable[[int], DataFrame], write_next: Callable[[DataFrame, int], None],
                 **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: each micro-batch makes the next profile snapshot.

    ``read_snapshot(epoch - 1)`` is the snapshot that an epoch starts from, and ``write_next(snapshot,
    epoch)`` must replace an epoch's output: a replayed epoch reads what it read before.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        write_next(upsert(read_snapshot(epoch - 1), batch, **options), epoch)
    return apply


# ---------------------------------------------------------------- ordered logs
#: Files of a part of an ordered log; a micro-batch reads one part.
FILES_PER_PART = 2


def ordered_log(df: DataFrame, by: Column, name: str, parts: int = 4, held_back: Column | None = None) -> DataFrame:
    """A table as a stream of ``parts`` micro-batches in the order of ``by`` (a number), and rows ``held_back`` as one more.

    Parts are written one after another, each in equally many files, and files are read in the order of their
    times, so state, watermark and timers work as they do on a log that grows.
    """
    root = shared_dir(df.sparkSession, f"log-{name}")
    late = F.lit(False) if held_back is None else F.coalesce(held_back, F.lit(False))
    on_time = df.where(~late)
    edges = on_time.agg(F.percentile_approx(by.cast("double"), [i / parts for i in range(1, parts)], 10_000).alias("e")).first().e or []
    bounds = [None, *sorted(set(edges)), None]
    pieces = [on_time.where((F.lit(True) if low is None else by.cast("double") > low) & (F.lit(True) if high is None else by.cast("double") <= high))
              for low, high in zip(bounds, bounds[1:])] + ([] if held_back is None else [df.where(late)])
    for piece in pieces:
        piece.repartition(FILES_PER_PART).write.mode("append").parquet(root)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", FILES_PER_PART).parquet(root)


def without_repeats(stream: DataFrame, *, ts: str, keys: Sequence[str], delay: str = "1 day") -> DataFrame:
    """Rows by their keys and time once; rows older than the watermark are dropped, and counted by ``drive``."""
    return stream.withWatermark(ts, delay).dropDuplicates([*keys, ts])


# ---------------------------------------------------------------- running
def run(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> DataFrame:
    """The result of ``drive``."""
    return drive(stream, name, mode, keys)[0]


def dropped_rows(progress: Sequence) -> int:
    """Rows that the stateful operators of a run have dropped because they came after the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in progress for op in p["stateOperators"])


def batches(progress: Sequence) -> int:
    """Micro-batches of a run that had rows."""
    return sum(p["numInputRows"] > 0 for p in progress)


def drive(stream: DataFrame, name: str, mode: str = "append", keys: Sequence[str] = ()) -> tuple[DataFrame, list]:
    """Process everything available; the result as a batch frame, and the progress of each micro-batch.

    In update mode every micro-batch is kept under its epoch and the last row per key wins.  In
    complete mode each micro-batch holds the whole result, so only the last epoch counts.
    """
    spark = stream.sparkSession
    root = shared_dir(spark, name)
    out = os.path.join(root, "out")
    writer = stream.writeStream.option("checkpointLocation", os.path.join(root, "checkpoint"))
    writer = writer.trigger(availableNow=True)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", out).start()
    else:
        def keep(batch: DataFrame, epoch: int) -> None:
            batch.write.mode("overwrite").parquet(os.path.join(out, f"epoch={epoch}"))
        query = writer.outputMode(mode).foreachBatch(keep).start()
    query.awaitTermination()
    progress = [json.loads(p.json) if hasattr(p, "json") and not callable(p.json) else p for p in query.recentProgress]
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out), progress
    result = spark.read.option("basePath", out).parquet(os.path.join(out, "epoch=*"))
    if mode == "complete":
        return result.where(F.col("epoch") == result.agg(F.max("epoch")).scalar()).drop("epoch"), progress
    rest = [c for c in stream.columns if c not in keys]
    return (result.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("_last"))
            .select(*keys, "_last.*")), progress
