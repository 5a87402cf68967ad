"""Offline ranking quality from the derived search log and feedback."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import FEEDBACK, SEARCHES, SHOWN, feedback_log, search_log, shown_log, table, with_
from matchweave.operators import evaluate as E

GRADES = """
grades AS (
  SELECT query_id, item, max(CASE WHEN event_type = 'profile_view' THEN 2 WHEN rating = 5 THEN 3 WHEN rating = 1 THEN 0 ELSE 1 END) AS g
  FROM feedback GROUP BY ALL),
lists AS (
  SELECT s.query_id, s.position, s.item, greatest(1, coalesce(g.g, 1)) AS grade, coalesce(g.g, 1) AS strict_grade
  FROM shown s LEFT JOIN grades g USING (query_id, item) WHERE s.query_id IN (SELECT query_id FROM grades))
"""

_LINEAR = """
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS best FROM lists),
per_query AS (
  SELECT query_id,
    sum(CASE WHEN position <= 5 THEN grade / log2(position + 1) ELSE 0 END) / sum(CASE WHEN best <= 5 THEN grade / log2(best + 1) ELSE 0 END) AS ndcg_5,
    sum(CASE WHEN position <= 10 THEN grade / log2(position + 1) ELSE 0 END) / sum(CASE WHEN best <= 10 THEN grade / log2(best + 1) ELSE 0 END) AS ndcg_10,
    coalesce(1.0 / min(CASE WHEN grade >= 2 THEN position END), 0) AS rr,
    count(CASE WHEN grade >= 2 AND position <= 5 THEN 1 END) / 5 AS precision_5
  FROM ideal GROUP BY query_id)
"""

LABELS = """
labels_b AS (
  SELECT query_id, item, max(CASE rating WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 WHEN 4 THEN 2.0 WHEN 5 THEN 3.0 ELSE 0.0 END)::DOUBLE AS grade
  FROM feedback GROUP BY ALL),
lists_b AS (SELECT s.query_id, s.position, s.item, coalesce(l.grade, 0) AS grade FROM shown s LEFT JOIN labels_b l USING (query_id, item)),
ideal_b AS (
  SELECT query_id, sum((2 ** grade - 1) / log2(best + 1)) AS idcg FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS best FROM labels_b) WHERE best <= 10 GROUP BY query_id),
per_query_b AS (
  SELECT query_id, CASE WHEN coalesce(idcg, 0) > 0 THEN dcg / idcg ELSE 0 END AS ndcg_10, rr, precision_5 FROM (
    SELECT query_id, sum(CASE WHEN position <= 10 THEN (2 ** grade - 1) / log2(position + 1) ELSE 0 END) AS dcg,
      coalesce(1.0 / min(CASE WHEN grade >= 1 THEN position END), 0) AS rr, count(CASE WHEN grade >= 1 AND position <= 5 THEN 1 END) / 5 AS precision_5
    FROM lists_b GROUP BY query_id) LEFT JOIN ideal_b USING (query_id))
"""


def _lists(spark, folder, strict=False):
    return E.graded_lists(shown_log(spark, folder), feedback_log(spark, folder), strict)


def _labels(spark, folder):
    return feedback_log(spark, folder).groupBy("query_id", "item").agg(
        F.max(E.relevance_from_rating(F.col("rating"))).alias("grade"))


def _metrics_a(spark, folder):
    return E.metrics(_lists(spark, folder))


def _metrics_b(spark, folder):
    labels = _labels(spark, folder)
    return E.metrics(E.labelled_lists(shown_log(spark, folder), labels), ndcg_at=(10,), threshold=1.0,
                     exponential=True, labels=labels)


def _rounded(df, digits=5):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("feedback_grades", with_(FEEDBACK) + """
SELECT query_id, item, CAST(max(CASE WHEN event_type = 'profile_view' THEN 2 WHEN rating = 5 THEN 3 WHEN rating = 1 THEN 0 ELSE 1 END) AS INTEGER) AS grade
FROM feedback GROUP BY ALL
""")
def feedback_grades(spark, folder):
    return E.best_grades(feedback_log(spark, folder))


@query("feedback_relevance", with_(FEEDBACK) + """
SELECT query_id, item, max(CASE rating WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 WHEN 4 THEN 2.0 WHEN 5 THEN 3.0 ELSE 0.0 END)::DOUBLE AS grade FROM feedback GROUP BY ALL
""")
def feedback_relevance(spark, folder):
    return _labels(spark, folder)


@query("relevance_lists", with_(FEEDBACK, SHOWN, GRADES) + """
SELECT l.query_id, l.position, l.item, l.grade::DOUBLE AS grade, l.strict_grade::DOUBLE AS strict_grade FROM lists l
""")
def relevance_lists(spark, folder):
    strict = _lists(spark, folder, strict=True).withColumnRenamed("grade", "strict_grade")
    return _lists(spark, folder).join(strict, ["query_id", "position", "item"])


@query("ranking_metrics_linear", with_(FEEDBACK, SHOWN, GRADES, _LINEAR) + """
SELECT query_id, round(ndcg_5, 5) AS ndcg_5, round(ndcg_10, 5) AS ndcg_10, round(rr, 5) AS rr, round(precision_5, 5) AS precision_5 FROM per_query
""")
def ranking_metrics_linear(spark, folder):
    return _rounded(_metrics_a(spark, folder))


@query("ranking_metrics_exponential", with_(FEEDBACK, SHOWN, LABELS) + """
SELECT query_id, round(ndcg_10, 5) AS ndcg_10, round(rr, 5) AS rr, round(precision_5, 5) AS precision_5 FROM per_query_b
""")
def ranking_metrics_exponential(spark, folder):
    return _rounded(_metrics_b(spark, folder))


@query("evaluation_summary", with_(FEEDBACK, SHOWN, LABELS) + """
SELECT round(avg(ndcg_10), 6) AS ndcg_at_k, round(avg(rr), 6) AS mrr, round(avg(precision_5), 6) AS precision_at_5, count(*) AS num_queries,
  round(stddev_pop(ndcg_10), 6) AS ndcg_std FROM per_query_b
""")
def evaluation_summary(spark, folder):
    return _rounded(E.summary(_metrics_b(spark, folder)), 6)


@query("worst_queries_first", with_(FEEDBACK, SHOWN, GRADES, _LINEAR) + """
SELECT query_id, round(ndcg_5, 4) AS ndcg_5 FROM per_query ORDER BY ndcg_5, query_id
""")
def worst_queries_first(spark, folder):
    return E.worst_first(_metrics_a(spark, folder).select("query_id", F.round("ndcg_5", 4).alias("ndcg_5")))


@query("relevant_in_top_five", with_(FEEDBACK, SHOWN) + """
SELECT query_id, count(*) AS hits FROM (
  SELECT query_id, item FROM shown WHERE position <= 5 INTERSECT SELECT query_id, item FROM feedback WHERE rating = 5) GROUP BY query_id
""")
def relevant_in_top_five(spark, folder):
    return E.overlap_at(shown_log(spark, folder), feedback_log(spark, folder).where("rating = 5"))


@query("evaluation_view", with_(SEARCHES, FEEDBACK) + """
SELECT s.id, s.free_text, count(*) AS feedback_count, round(avg(f.rating), 6) AS avg_rating, CAST(sum(CASE WHEN f.booked THEN 1 ELSE 0 END) AS BIGINT) AS bookings
FROM searches s JOIN feedback f ON f.query_id = s.id GROUP BY s.id, s.free_text HAVING count(*) >= 1
""")
def evaluation_view(spark, folder):
    return E.evaluation_queries(search_log(spark, folder), feedback_log(spark, folder)).withColumn(
        "avg_rating", F.round("avg_rating", 6))


@query("searches_joined_to_feedback", with_(SEARCHES, FEEDBACK) + """
SELECT s.session_id, f.event_type, count(*) AS n FROM searches s JOIN feedback f ON f.query_id = s.id GROUP BY ALL
""")
def searches_joined_to_feedback(spark, folder):
    per_search = feedback_log(spark, folder).groupBy("query_id", "event_type").agg(F.count("*").alias("_n"))
    rows = search_log(spark, folder).join(per_search, F.col("id") == F.col("query_id"))
    return rows.groupBy("session_id", "event_type").agg(F.sum("_n").alias("n"))


@query("metric_regressions", """
SELECT run, round(value, 4) AS value, round(prev, 4) AS prev_value, coalesce(prev - value > 0.5, FALSE) AS regressed FROM (
  SELECT run, value, lag(value) OVER (ORDER BY run) AS prev FROM (
    SELECT date_trunc('day', ts) AS d, strftime(date_trunc('day', ts), '%Y-%m-%d') AS run, avg(value) AS value FROM events GROUP BY ALL))
""")
def metric_regressions(spark, folder):
    runs = table(spark, folder, "events").groupBy(F.date_trunc("day", "ts").alias("created_at")).agg(
        F.avg("value").alias("value"))
    rows = E.regressions(runs, "value", drop=0.5)
    return rows.select(F.date_format("created_at", "yyyy-MM-dd").alias("run"), F.round("value", 4).alias("value"),
                       F.round("prev_value", 4).alias("prev_value"), "regressed")
