"""Online metrics, counters, rate limit and result reuse."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import (
    FEEDBACK, PROFILES, SEARCHES, feedback_log, profiles, search_log, table, with_)
from matchweave import vocab
from matchweave.functions.hist import exact_percentile
from matchweave.operators import online as M
from matchweave.operators.traffic import rate_limit, result_reuse

AS_OF, DAYS = "1999-06-30 00:00:00", 365
WINDOW = with_(SEARCHES, FEEDBACK, f"""
s AS (SELECT * FROM searches WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at <= TIMESTAMP '{AS_OF}'),
f AS (SELECT * FROM feedback WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL {DAYS} DAY AND created_at <= TIMESTAMP '{AS_OF}')""")


def _searches(spark, folder):
    return M.recent(search_log(spark, folder), AS_OF, DAYS)


def _feedback(spark, folder):
    return M.recent(feedback_log(spark, folder), AS_OF, DAYS)


def _rounded(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("online_volume", WINDOW + """
SELECT count(*) AS total_searches, count(DISTINCT session_id) AS total_sessions, round(avg(cache_hit::INT), 6) AS cache_hit_rate,
  round(avg(CASE WHEN latency_ms > 0 THEN latency_ms END), 6) AS avg_latency_ms,
  round(avg(CASE WHEN filtered_count = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_result_rate FROM s
""")
def online_volume(spark, folder):
    return _rounded(M.volume(_searches(spark, folder)))


@query("online_feedback_rate", WINDOW + """
SELECT (SELECT count(*) FROM s) AS total_searches, count(DISTINCT s.id) AS searches_with_feedback,
  round(count(DISTINCT s.id) / (SELECT count(*) FROM s), 6) AS feedback_rate FROM s JOIN feedback f ON f.query_id = s.id
""")
def online_feedback_rate(spark, folder):
    return _rounded(M.feedback_rate(_searches(spark, folder), feedback_log(spark, folder)))


@query("online_feedback_rates", WINDOW + """
SELECT round(avg(CASE WHEN event_type = 'explicit' THEN CASE WHEN rating = 5 THEN 1.0 ELSE 0.0 END END), 6) AS thumbs_up_rate,
  count(DISTINCT CASE WHEN event_type = 'profile_view' THEN query_id END) AS searches_with_view,
  round(count(DISTINCT CASE WHEN event_type = 'profile_view' THEN query_id END) / (SELECT count(*) FROM s), 6) AS profile_view_rate FROM f
""")
def online_feedback_rates(spark, folder):
    return _rounded(M.feedback_rates(_feedback(spark, folder), _searches(spark, folder)))


@query("online_reformulation", WINDOW + """
SELECT round(avg(n), 6) AS avg_queries_per_session, count(CASE WHEN n > 1 THEN 1 END) AS multi_query_sessions, count(*) AS total_sessions
FROM (SELECT session_id, count(*) AS n FROM s GROUP BY 1)
""")
def online_reformulation(spark, folder):
    return _rounded(M.reformulation(_searches(spark, folder)))


@query("online_position_bias", WINDOW + """
SELECT rank_position, count(*) AS total, round(avg(CASE WHEN rating = 5 THEN 1.0 ELSE 0.0 END), 6) AS thumbs_up_rate,
  round(avg(CASE WHEN event_type = 'profile_view' THEN 1.0 ELSE 0.0 END), 6) AS view_rate FROM f GROUP BY 1 ORDER BY 1 LIMIT 10
""")
def online_position_bias(spark, folder):
    return _rounded(M.position_bias(_feedback(spark, folder)))


@query("online_top_reformulating", WINDOW + """,
top AS (SELECT session_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, session_id LIMIT 5)
SELECT session_id, n AS query_count, string_agg(free_text, ' -> ' ORDER BY rn) AS queries FROM (
  SELECT s.session_id, n, free_text, row_number() OVER (PARTITION BY s.session_id ORDER BY created_at, id) AS rn FROM s JOIN top USING (session_id))
WHERE rn <= 3 GROUP BY ALL
""".replace(",\ntop", ", top", 1))
def online_top_reformulating(spark, folder):
    return M.top_reformulating(_searches(spark, folder))


@query("online_session_queries", WINDOW + """
SELECT session_id, n AS query_count, id, free_text FROM s JOIN (SELECT session_id, count(*) AS n FROM s GROUP BY 1 HAVING count(*) > 1) USING (session_id)
""")
def online_session_queries(spark, folder):
    return M.session_queries(_searches(spark, folder)).drop("created_at")


@query("online_alerts", WINDOW + """
SELECT round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms, round(avg(CASE WHEN filtered_count = 9 THEN 1.0 ELSE 0.0 END), 6) AS error_rate,
  round(avg(cache_hit::INT), 6) AS cache_hit_rate, quantile_cont(latency_ms, 0.99) > 2000 AS latency_alert,
  avg(CASE WHEN filtered_count = 9 THEN 1.0 ELSE 0.0 END) > 0.01 AS error_alert, avg(cache_hit::INT) < 0.4 AS cache_alert FROM s
""")
def online_alerts(spark, folder):
    return _rounded(M.alerts(_searches(spark, folder), F.col("filtered_count") == 9))


@query("slow_searches", with_(SEARCHES) + "SELECT id, session_id FROM searches WHERE latency_ms > 3000")
def slow_searches(spark, folder):
    return M.slow_queries(search_log(spark, folder), 3000.0).select("id", "session_id")


@query("exact_percentile_prices", """
SELECT round(quantile_cont(l_extendedprice, 0.995), 6) AS l_extendedprice, count(*) AS n FROM lineitem
""")
def exact_percentile_prices(spark, folder):
    return _rounded(exact_percentile(table(spark, folder, "lineitem"), "l_extendedprice", 0.995))


# ---------------------------------------------------------------- histograms and counters
def _buckets_sql(value: str, buckets) -> str:
    rows = ", ".join(f"({float(b)}::DOUBLE)" for b in buckets) + ", (NULL)"
    return f"""
SELECT event_type, le, count(CASE WHEN le IS NULL OR {value} <= le THEN 1 END) AS n
FROM events, (VALUES {rows}) b(le) GROUP BY ALL"""


@query("latency_histogram", _buckets_sql("value * 10", vocab.LATENCY_BUCKETS))
def latency_histogram(spark, folder):
    rows = table(spark, folder, "events").withColumn("ms", F.col("value") * 10)
    return M.latency_histogram(rows, "ms", vocab.LATENCY_BUCKETS, ["event_type"])


@query("score_histogram", _buckets_sql("value / 100", vocab.SCORE_BUCKETS))
def score_histogram(spark, folder):
    rows = table(spark, folder, "events").withColumn("score", F.col("value") / 100)
    return M.latency_histogram(rows, "score", vocab.SCORE_BUCKETS, ["event_type"])


def _register_histogram(name: str, source: str, sql_value: str, spark_value, buckets) -> None:
    rows = ", ".join(f"({float(b)}::DOUBLE)" for b in buckets) + ", (NULL)"

    @query(name, with_(SEARCHES, FEEDBACK) + f"""
SELECT le, count(CASE WHEN le IS NULL OR v <= le THEN 1 END) AS n FROM (SELECT {sql_value} AS v FROM {source}), (VALUES {rows}) b(le) GROUP BY le""")
    def run(spark, folder):
        log = search_log(spark, folder) if source == "searches" else feedback_log(spark, folder)
        return M.latency_histogram(log.select(spark_value().alias("v")), "v", buckets)


_register_histogram("query_latency_histogram", "searches", "latency_ms / 2", lambda: F.col("latency_ms") / 2, vocab.QUERY_LATENCY_BUCKETS)
_register_histogram("db_latency_histogram", "searches", "latency_ms / 10", lambda: F.col("latency_ms") / 10, vocab.DB_LATENCY_BUCKETS)
_register_histogram("rating_histogram", "feedback", "rating", lambda: F.col("rating"), vocab.RATING_BUCKETS)
_register_histogram("candidate_histogram", "searches", "filtered_count", lambda: F.col("filtered_count"), vocab.CANDIDATE_BUCKETS)


@query("label_counters", """
SELECT event_type, count(*) AS requests, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1
""")
def label_counters(spark, folder):
    rows = table(spark, folder, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    requests = M.counters(rows, "event_type").withColumnRenamed("total", "requests")
    return requests.join(M.counters(rows, "event_type", "k").withColumnRenamed("total", "tokens"), "event_type")


@query("token_cost", """
SELECT model, tokens, round(tokens * CASE model WHEN 'small' THEN 0.00000025 WHEN 'large' THEN 0.000015 ELSE 0.000001 END, 8)::DOUBLE AS cost_usd FROM (
  SELECT CASE event_type WHEN 'click' THEN 'small' WHEN 'view' THEN 'large' ELSE event_type END AS model,
    CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1)
""")
def token_cost(spark, folder):
    model = F.when(F.col("event_type") == "click", "small").when(F.col("event_type") == "view", "large").otherwise(F.col("event_type"))
    usage = table(spark, folder, "events").select(
        model.alias("model"), F.get_json_object("props", "$.k").cast("bigint").alias("tokens"))
    return _rounded(M.token_cost(usage, prices={"small": 0.00000025, "large": 0.000015}), 8)


# ---------------------------------------------------------------- facets
@query("facet_values", with_(PROFILES) + """
SELECT DISTINCT facet, value FROM (
  SELECT 'city' AS facet, city AS value FROM profiles WHERE is_active UNION ALL SELECT 'language', unnest(languages) FROM profiles WHERE is_active
  UNION ALL SELECT 'ethnicity', unnest(ethnicity) FROM profiles WHERE is_active) WHERE coalesce(value, '') <> ''
""")
def facet_values(spark, folder):
    return M.facet_values(profiles(spark, folder))


@query("total_accepting", with_(PROFILES) + "SELECT count(*) AS total FROM profiles WHERE is_active AND accepting_new_clients")
def total_accepting(spark, folder):
    return M.total_accepting(profiles(spark, folder))


# ---------------------------------------------------------------- sliding window and reuse
_DAY_MS = 86_400_000


@query("rate_limit_day", """
WITH instants AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, count(*) AS requests FROM events GROUP BY ALL),
prior AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN 86399999 PRECEDING AND 1 PRECEDING) AS prior FROM instants)
SELECT user_id, ms, requests, prior, CAST((prior < 5)::INT + CASE WHEN prior + 1 < 5 THEN requests - 1 ELSE 0 END AS BIGINT) AS allowed,
  CAST(requests - (prior < 5)::INT - CASE WHEN prior + 1 < 5 THEN requests - 1 ELSE 0 END AS BIGINT) AS denied FROM prior
""")
def rate_limit_day(spark, folder):
    return rate_limit(table(spark, folder, "events"), client="user_id", ts="ts", limit=5, window_ms=_DAY_MS)


@query("rate_limit_minute", """
WITH instants AS (SELECT event_type, epoch_us(ts) // 1000 // 60000 * 1000 AS ms, count(*) AS requests FROM events GROUP BY ALL),
prior AS (SELECT *, count(*) OVER (PARTITION BY event_type ORDER BY ms RANGE BETWEEN 59999 PRECEDING AND 1 PRECEDING) AS prior FROM instants)
SELECT event_type, ms, requests, prior, CAST((prior < 3)::INT + CASE WHEN prior + 1 < 3 THEN requests - 1 ELSE 0 END AS BIGINT) AS allowed,
  CAST(requests - (prior < 3)::INT - CASE WHEN prior + 1 < 3 THEN requests - 1 ELSE 0 END AS BIGINT) AS denied FROM prior
""")
def rate_limit_minute(spark, folder):
    """The default window on a clock sixty times as fast, so that it fills."""
    fast = F.timestamp_millis(F.floor(F.unix_millis("ts") / 60000) * 1000)
    return rate_limit(table(spark, folder, "events").withColumn("ts", fast), client="event_type", ts="ts", limit=3)


@query("result_reuse", """
WITH RECURSIVE instants AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, count(*) AS requests FROM events GROUP BY ALL),
following AS (
  SELECT a.user_id, a.ms, min(b.ms) AS nxt FROM instants a LEFT JOIN instants b ON b.user_id = a.user_id AND b.ms >= a.ms + 259200000 GROUP BY ALL),
misses AS (
  SELECT user_id, min(ms) AS ms FROM instants GROUP BY 1
  UNION ALL SELECT m.user_id, f.nxt FROM misses m JOIN following f USING (user_id, ms) WHERE f.nxt IS NOT NULL)
SELECT user_id, ms, requests, (m.ms IS NOT NULL)::BIGINT AS misses, requests - (m.ms IS NOT NULL)::BIGINT AS hits
FROM instants LEFT JOIN (SELECT user_id, ms AS ms FROM misses) m USING (user_id, ms)
""")
def result_reuse_events(spark, folder):
    return result_reuse(table(spark, folder, "events"), key="user_id", ts="ts", ttl_seconds=259200, stretch_ttls=3)
