"""Engagement metrics over the search and feedback logs, for a window ending at ``as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.hist import exact_percentile, histogram
from matchweave.operators.filters import active, active_accepting


def recent(df: DataFrame, as_of: str, days: int = 7, ts: str = "created_at") -> DataFrame:
    """Rows after ``as_of`` minus ``days`` up to ``as_of``; both bounds are constants, so the scan is pruned."""
    until = F.lit(as_of).cast("timestamp")
    since = F.timestamp_seconds(F.unix_seconds(until) - days * 86400)
    return df.where((F.col(ts) > since) & (F.col(ts) <= until))


def _rate(condition: Column) -> Column:
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def volume(searches: DataFrame) -> DataFrame:
    """One pass: searches, distinct sessions, cache hit rate, mean positive latency, zero results."""
    return searches.agg(
        F.count("*").alias("total_searches"),
        F.count_distinct("session_id").alias("total_sessions"),
        F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"),
        F.avg(F.when(F.col("latency_ms") > 0, F.col("latency_ms").cast("double"))).alias("avg_latency_ms"),
        _rate(F.col("filtered_count") == 0).alias("zero_result_rate"))


def approximate_sessions(searches: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Distinct sessions by sketch, for windows where the exact count is not needed."""
    return searches.agg(F.approx_count_distinct("session_id", rsd).alias("total_sessions"))


def feedback_rate(searches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Share of searches with feedback; NULL without searches.

    Feedback is made distinct by query first: one row per query reaches the join.
    """
    with_feedback = searches.select("id").join(
        feedback.select(F.col("query_id").alias("id")).distinct(), "id", "left_semi")
    return (searches.agg(F.count("*").alias("total_searches"))
            .select("total_searches",
                    with_feedback.agg(F.count("*").alias("n")).scalar().alias("searches_with_feedback"))
            .withColumn("feedback_rate", F.try_divide("searches_with_feedback", "total_searches")))


def feedback_rates(feedback: DataFrame, searches: DataFrame) -> DataFrame:
    """Thumbs-up rate of explicit events, and profile views per search."""
    total = searches.agg(F.count("*").alias("n")).scalar()
    explicit = F.col("event_type") == "explicit"
    return feedback.agg(
        F.avg(F.when(explicit & (F.col("rating") == 5), 1.0).when(explicit, 0.0)).alias("thumbs_up_rate"),
        F.count_distinct(F.when(F.col("event_type") == "profile_view", F.col("query_id")))
        .alias("searches_with_view"),
    ).withColumn("profile_view_rate", F.try_divide(F.col("searches_with_view"), total))


def session_counts(searches: DataFrame) -> DataFrame:
    return (searches.where(F.col("session_id").isNotNull())
            .groupBy("session_id").agg(F.count("*").alias("query_count")))


def reformulation(searches: DataFrame) -> DataFrame:
    """Mean searches per session and how many sessions searched more than once."""
    return session_counts(searches).agg(
        F.avg("query_count").alias("avg_queries_per_session"),
        F.count(F.when(F.col("query_count") > 1, 1)).alias("multi_query_sessions"),
        F.count("*").alias("total_sessions"))


def position_bias(feedback: DataFrame, positions: int = 10) -> DataFrame:
    """Events, thumbs-up rate and view rate by rank, for the first positions (a report)."""
    return (feedback.where(F.col("rank_position").isNotNull()).groupBy("rank_position").agg(
        F.count("*").alias("total"), _rate(F.col("rating") == 5).alias("thumbs_up_rate"),
        _rate(F.col("event_type") == "profile_view").alias("view_rate"))
        .orderBy("rank_position").limit(positions))


def session_queries(searches: DataFrame, minimum: int = 2) -> DataFrame:
    """All searches of sessions with at least ``minimum`` of them, one row each.

    A session's texts stay rows: a session may be arbitrarily long.
    """
    busy = session_counts(searches).where(F.col("query_count") >= minimum)
    return searches.join(busy, "session_id").select(
        "session_id", "query_count", "created_at", "id", "free_text")


def top_reformulating(searches: DataFrame, n: int = 5, preview: int = 3) -> DataFrame:
    """The n sessions with most searches and their first texts (a report).

    Counts decide the sessions first; only their rows are looked at again, and a session
    brings at most ``preview`` rows to the list.
    """
    top = (session_counts(searches).where(F.col("query_count") > 1)
           .orderBy(F.col("query_count").desc(), "session_id").limit(n))
    rows = searches.join(F.broadcast(top), "session_id")
    w = Window.partitionBy("session_id").orderBy("created_at", "id")
    first = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= preview)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("_rn", "free_text"))),
                        lambda e: F.coalesce(e["free_text"], F.lit("(empty)")))
    return first.groupBy("session_id", "query_count").agg(F.array_join(texts, " -> ").alias("queries"))


# ---------------------------------------------------------------- counters and cost
def counters(df: DataFrame, label: str, value: str | None = None) -> DataFrame:
    """Totals by label: row counts, or sums of ``value``."""
    total = F.count("*") if value is None else F.sum(value)
    return df.groupBy(label).agg(total.alias("total"))


def latency_histogram(df: DataFrame, value: str, buckets: Sequence[float] = vocab.LATENCY_BUCKETS,
                      by: Sequence[str] = ()) -> DataFrame:
    return histogram(df, value, buckets, by)


def token_cost(usage: DataFrame, model: str = "model", tokens: str = "tokens",
               prices: dict[str, float] = vocab.TOKEN_PRICES,
               default: float = vocab.DEFAULT_TOKEN_PRICE) -> DataFrame:
    """Tokens and estimated cost by model; an unknown model has the default price."""
    table = F.create_map(*[F.lit(x) for kv in prices.items() for x in kv])
    price = F.coalesce(F.try_element_at(table, F.col(model)), F.lit(default))
    return (usage.groupBy(model).agg(F.sum(tokens).alias("tokens"))
            .withColumn("cost_usd", F.col("tokens") * price))


def alerts(searches: DataFrame, errors: Column, latency: str = "latency_ms",
           limits: dict[str, float] = vocab.ALERTS) -> DataFrame:
    """P99 latency (exact), error rate and hit rate with their alert flags, as one row.

    The rates are one scan, the percentile two to four (``exact_percentile``), none of which sorts rows.
    """
    p99 = exact_percentile(searches, latency, 0.99)
    rates = searches.agg(_rate(errors).alias("error_rate"),
                         F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate"))
    row = rates.withColumn("p99_latency_ms", p99.select(latency).scalar())
    return row.select(
        "p99_latency_ms", "error_rate", "cache_hit_rate",
        (F.col("p99_latency_ms") > limits["p99_latency_ms"]).alias("latency_alert"),
        (F.col("error_rate") > limits["error_rate"]).alias("error_alert"),
        (F.col("cache_hit_rate") < limits["cache_hit_rate"]).alias("cache_alert"))


def slow_queries(searches: DataFrame, threshold_ms: float = 5000.0) -> DataFrame:
    return searches.where(F.col("latency_ms") > threshold_ms)


# ---------------------------------------------------------------- facets
def facet_values(profiles: DataFrame) -> DataFrame:
    """(facet, value): distinct non-empty cities, languages and ethnicities of active profiles."""
    def named(facet: str, values: Column) -> Column:
        return F.transform(F.coalesce(values, F.array().cast("array<string>")),
                           lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))

    pairs = F.concat(named("city", F.array("city")), named("language", F.col("languages")),
                     named("ethnicity", F.col("ethnicity")))
    rows = profiles.where(active()).select(F.inline(pairs))
    return rows.where(F.coalesce("value", F.lit("")) != "").distinct().orderBy("facet", "value")


def total_accepting(profiles: DataFrame) -> DataFrame:
    return profiles.where(active_accepting()).agg(F.count("*").alias("total"))
