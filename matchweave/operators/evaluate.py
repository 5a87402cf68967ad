"""Offline ranking quality from logged result lists and feedback.

A *shown* table has one row per (query, position, item); positions are 1-based.  Everything
is a grouped sum: the ideal ordering needs only how many items hold each grade, because
grades come from a small fixed set, so no list is sorted or gathered.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.hist import bucketed_lag

SHOWN_GRADE = 1


# ---------------------------------------------------------------- grades
def grade_from_event(rating: Column, event_type: Column) -> Column:
    """0-3: a profile view is 2, thumbs-up 3, thumbs-down 0, anything else 1."""
    return (F.when(F.coalesce(event_type, F.lit("explicit")) == "profile_view", 2)
            .when(rating == 5, 3).when(rating == 1, 0).otherwise(1))


def relevance_from_rating(rating: Column) -> Column:
    """Star rating to 0-3."""
    return (F.when(rating == 2, 0.5).when(rating == 3, 1.0).when(rating == 4, 2.0)
            .when(rating == 5, 3.0).otherwise(0.0))


def shown_rows(searches: DataFrame, key: str = "id", results: str = "result_ids") -> DataFrame:
    """(query_id, position, item) from the ordered result ids of the search log."""
    return searches.where(F.size(results) > 0).select(
        F.col(key).alias("query_id"), F.posexplode(results).alias("position", "item")
    ).withColumn("position", F.col("position") + 1)


def best_grades(feedback: DataFrame) -> DataFrame:
    """(query_id, item, grade): the best grade of several events on one result."""
    return feedback.groupBy("query_id", "item").agg(
        F.max(grade_from_event(F.col("rating"), F.col("event_type"))).alias("grade"))


def graded_lists(shown: DataFrame, feedback: DataFrame, strict: bool = False) -> DataFrame:
    """(query_id, position, item, grade) of the queries that have feedback.

    Every shown item starts at 1 and takes its feedback grade if that is higher; ``strict``
    lets the feedback grade replace it, so a thumbs-down counts as 0.
    """
    grades = best_grades(feedback)
    judged = shown.join(grades.select("query_id").distinct(), "query_id", "left_semi")
    rows = judged.join(grades, ["query_id", "item"], "left")
    base = F.lit(SHOWN_GRADE)
    grade = F.coalesce("grade", base) if strict else F.greatest(base, F.coalesce("grade", base))
    return rows.withColumn("grade", grade.cast("double"))


# ---------------------------------------------------------------- metrics per query
def _gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def _discount_total(n: Column, k: int) -> Column:
    """Sum of the discounts of the first n positions, at most k."""
    sums, total = [0.0], 0.0
    for position in range(1, k + 1):
        total += 1 / math.log2(position + 1)
        sums.append(total)
    return F.get(F.array(*[F.lit(s) for s in sums]), F.least(n, F.lit(k)).cast("int"))


def _ideal(ks: tuple[int, ...], exponential: bool) -> list[Column]:
    """Best possible DCG per k, from rows (query, grade, n, _end) with ``_end`` = items this good."""
    start = F.col("_end") - F.col("n")
    return [F.sum(_gain(F.col("grade"), exponential)
                  * (_discount_total(F.col("_end"), k) - _discount_total(start, k))).alias(f"_idcg{k}")
            for k in ks]


def _best_first(per_grade: DataFrame) -> DataFrame:
    """Running number of items per query from the best grade down; a handful of rows a query."""
    better = Window.partitionBy("query_id").orderBy(F.col("grade").desc()).rowsBetween(
        Window.unboundedPreceding, 0)
    return per_grade.withColumn("_end", F.sum("n").over(better))


def metrics(lists: DataFrame, *, ndcg_at: tuple[int, ...] = (5, 10), precision_at: int = 5,
            threshold: float = 2, exponential: bool = False,
            labels: DataFrame | None = None) -> DataFrame:
    """(query_id, ndcg_<k>..., rr, precision_<k>) for graded result lists.

    ``labels`` (query_id, item, grade) makes the ideal order use all known labels, shown or
    not; without it the ideal is the best order of the shown items.  The lists are read once:
    one row per (query, grade) carries all sums on.
    """
    discount = 1 / F.log2(F.col("position") + 1)
    per_grade = lists.groupBy("query_id", "grade").agg(
        F.count("*").alias("n"), F.min("position").alias("_first"),
        F.count(F.when(F.col("position") <= precision_at, 1)).alias("_head"),
        *[F.sum(F.when(F.col("position") <= k, discount).otherwise(0.0)).alias(f"_d{k}") for k in ndcg_at])
    gain, hit = _gain(F.col("grade"), exponential), F.col("grade") >= threshold
    own_ideal = _ideal(ndcg_at, exponential) if labels is None else []
    per_query = _best_first(per_grade).groupBy("query_id").agg(
        *[F.sum(gain * F.col(f"_d{k}")).alias(f"_dcg{k}") for k in ndcg_at], *own_ideal,
        F.coalesce(1.0 / F.min(F.when(hit, F.col("_first"))), F.lit(0.0)).alias("rr"),
        (F.sum(F.when(hit, F.col("_head")).otherwise(0)) / precision_at).alias(f"precision_{precision_at}"))
    if labels is not None:
        counted = labels.groupBy("query_id", "grade").agg(F.count("*").alias("n"))
        ideal = _best_first(counted).groupBy("query_id").agg(*_ideal(ndcg_at, exponential))
        per_query = per_query.join(ideal, "query_id", "left")
    ndcg = [F.when(F.col(f"_idcg{k}") > 0, F.col(f"_dcg{k}") / F.col(f"_idcg{k}")).otherwise(0.0)
            .alias(f"ndcg_{k}") for k in ndcg_at]
    return per_query.select("query_id", *ndcg, "rr", f"precision_{precision_at}")


def labelled_lists(shown: DataFrame, labels: DataFrame) -> DataFrame:
    """Shown rows with their label; an unlabelled item has relevance 0."""
    return shown.join(labels, ["query_id", "item"], "left").withColumn(
        "grade", F.coalesce("grade", F.lit(0.0)))


def overlap_at(shown: DataFrame, relevant: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, hits): size of the intersection of the first k items and the relevant ones."""
    head = shown.where(F.col("position") <= k).select("query_id", "item")
    return head.intersect(relevant.select("query_id", "item")).groupBy("query_id").agg(
        F.count("*").alias("hits"))


def summary(per_query: DataFrame, ndcg: str = "ndcg_10", precision: str = "precision_5") -> DataFrame:
    """One row of means; all zero when there is nothing to evaluate."""
    def mean(column: str) -> Column:
        return F.coalesce(F.avg(column), F.lit(0.0))

    return per_query.agg(
        mean(ndcg).alias("ndcg_at_k"), mean("rr").alias("mrr"), mean(precision).alias("precision_at_5"),
        F.count("*").alias("num_queries"),
        F.coalesce(F.stddev_pop(ndcg), F.lit(0.0)).alias("ndcg_std"))


def worst_first(per_query: DataFrame, metric: str = "ndcg_5") -> DataFrame:
    return per_query.orderBy(F.col(metric).asc(), "query_id")


# ---------------------------------------------------------------- runs
def evaluation_run(per_query: DataFrame, run_name: str, created_at: Column,
                   config: dict | None = None) -> DataFrame:
    """One evaluation run row with a JSON snapshot of the configuration."""
    snapshot = config or {f"weight_{k}": v for k, v in vocab.WEIGHTS.items()}
    values = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in snapshot.items()]))
    return summary(per_query).select(
        F.expr("uuid()").alias("id"), F.lit(run_name).alias("run_name"),
        F.round("ndcg_at_k", 4).alias("ndcg_at_10"), F.round("mrr", 4).alias("mrr"),
        F.round("precision_at_5", 4).alias("precision_at_5"),
        F.col("num_queries").cast("int").alias("num_queries"), values.alias("config_snapshot"),
        created_at.alias("created_at"))


def regressions(runs: DataFrame, metric: str = "ndcg_at_10", order: str = "created_at",
                drop: float = vocab.REGRESSION_DROP) -> DataFrame:
    """Runs with the metric of the run before and whether it fell by more than ``drop``."""
    rows = bucketed_lag(runs, order, F.date_trunc("month", F.col(order)), [metric])
    fall = F.col(f"prev_{metric}").cast("double") - F.col(metric).cast("double")
    return rows.withColumn("regressed", F.coalesce(fall > drop, F.lit(False)))


def evaluation_queries(searches: DataFrame, feedback: DataFrame) -> DataFrame:
    """Searches with feedback: number of events, mean rating, bookings.

    Feedback is summed per search before the join, so a search with very many events meets
    the join as one row.
    """
    per_search = feedback.groupBy("query_id").agg(
        F.count("*").alias("feedback_count"), F.avg("rating").alias("avg_rating"),
        F.sum(F.when(F.col("booked"), 1).otherwise(0)).alias("bookings"))
    rows = searches.join(per_search.where(F.col("feedback_count") >= 1),
                         searches["id"] == F.col("query_id")).drop("query_id")
    keep = [c for c in ("id", "free_text", "extracted_intent", "result_ids") if c in searches.columns]
    return rows.select(*keep, "feedback_count", "avg_rating", "bookings")
