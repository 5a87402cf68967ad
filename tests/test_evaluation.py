"""Offline metrics: golden values, brute force, skewed lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from matchweave.operators import evaluate as E
from matchweave.sources import tables as T


def lists(spark, grades, query="q"):
    return spark.createDataFrame([(query, i + 1, f"d{i}", float(g)) for i, g in enumerate(grades)],
                                 "query_id string, position int, item string, grade double")


@pytest.mark.parametrize("grades, exponential, expected", [
    ([1, 3, 1, 2], False, 0.81928), ([0, 0, 1, 2, 3], False, 0.529606), ([0, 0, 1, 2, 3], True, 0.479091),
    ([3, 2, 1, 0, 0], False, 1.0), ([3, 2, 1, 0, 0], True, 1.0), ([0, 0, 0], True, 0.0), ([0, 0], False, 0.0)])
def test_ndcg(spark, grades, exponential, expected):
    row = E.metrics(lists(spark, grades), ndcg_at=(5,), exponential=exponential).first()
    assert row.ndcg_5 == pytest.approx(expected, abs=1e-5)


def test_ideal_uses_unshown_labels(spark):
    shown = lists(spark, [1, 0])
    labels = spark.createDataFrame([("q", "d0", 1.0), ("q", "hidden", 3.0)], "query_id string, item string, grade double")
    row = E.metrics(E.labelled_lists(shown.drop("grade"), labels), ndcg_at=(10,), exponential=True, threshold=1.0,
                    labels=labels).first()
    assert row.ndcg_10 == pytest.approx(1 / (7 + 1 / math.log2(3)))


@pytest.mark.parametrize("grades, rr", [([2, 0], 1), ([1, 3], 0.5), ([1, 1], 0)])
def test_reciprocal_rank(spark, grades, rr):
    assert E.metrics(lists(spark, grades)).first().rr == rr


def test_precision_divides_by_k(spark):
    assert E.metrics(lists(spark, [1, 3, 1, 2])).first().precision_5 == pytest.approx(0.4)


def test_metrics_match_brute_force_on_long_lists(spark):
    rng = random.Random(4)
    data = {f"q{i}": [rng.choice([0, 0.5, 1, 2, 3]) for _ in range(400 if i == 0 else rng.randint(1, 30))] for i in range(20)}
    rows = [(q, p + 1, f"{q}-{p}", float(g)) for q, gs in data.items() for p, g in enumerate(gs)]
    df = spark.createDataFrame(rows, "query_id string, position int, item string, grade double")
    for exponential in (False, True):
        def gain(g):
            return 2 ** g - 1 if exponential else g

        def dcg(gs):
            return sum(gain(g) / math.log2(i + 2) for i, g in enumerate(gs[:10]))

        want = {q: (dcg(gs) / dcg(sorted(gs, reverse=True)) if any(gs) else 0.0) for q, gs in data.items()}
        got = {r.query_id: r.ndcg_10 for r in E.metrics(df, exponential=exponential).collect()}
        assert got == pytest.approx(want)


def feedback(spark, rows):
    return spark.createDataFrame(rows, "query_id string, item string, rating int, event_type string")


def test_relevance_rebuild(spark):
    searches = spark.createDataFrame([("q", ["a", "b", "c", "d"]), ("empty", []), ("quiet", ["a"])],
                                     "id string, result_ids array<string>")
    fb = feedback(spark, [("q", "b", 5, "explicit"), ("q", "b", 1, "explicit"), ("q", "c", 1, "explicit"),
                          ("q", "d", 1, "profile_view"), ("empty", "a", 5, "explicit")])
    shown = E.shown_rows(searches)

    def grades(strict):
        out = E.graded_lists(shown, fb, strict)
        assert {r.query_id for r in out.collect()} == {"q"}
        return [r.grade for r in out.orderBy("position").collect()], E.metrics(out, ndcg_at=(5,)).first().ndcg_5

    assert grades(False) == ([1, 3, 1, 2], pytest.approx(0.81928, abs=1e-5))
    assert grades(True) == ([1, 3, 0, 2], pytest.approx(0.788377, abs=1e-5))


def test_grade_maps(one):
    got = [one(E.grade_from_event(F.lit(r), F.lit(e).cast("string"))) for r, e in
           [(1, "profile_view"), (5, "explicit"), (1, "explicit"), (3, None)]]
    assert got == [2, 3, 0, 1]
    assert [one(E.relevance_from_rating(F.lit(r))) for r in (1, 2, 3, 4, 5, 9)] == [0, 0.5, 1, 2, 3, 0]


def test_summary_of_nothing_is_zero(spark):
    empty = E.metrics(lists(spark, [1]).where("false"))
    assert tuple(E.summary(empty).first()) == (0, 0, 0, 0, 0)


def test_summary_uses_population_deviation(spark):
    df = lists(spark, [3, 0], "a").union(lists(spark, [0, 3], "b"))
    row = E.summary(E.metrics(df)).first()
    low = 1 / math.log2(3)
    assert row.ndcg_std == pytest.approx((1 - low) / 2) and row.num_queries == 2


def test_run_append_history_and_regression(spark, tmp_path):
    path = str(tmp_path / "runs")
    for day, grades in (("2024-01-30", [3, 0]), ("2024-02-02", [0, 3]), ("2024-02-03", [0, 3])):
        run = E.evaluation_run(E.metrics(lists(spark, grades)), f"run {day}", F.lit(day).cast("timestamp"))
        T.append_eval_run(run, path)
    runs = spark.read.parquet(path)
    assert [r.run_name for r in T.newest(runs, "created_at", 2).collect()] == ["run 2024-02-03", "run 2024-02-02"]
    assert '"weight_modality":0.4' in runs.first().config_snapshot
    flagged = E.regressions(runs).orderBy("created_at").collect()
    assert [r.regressed for r in flagged] == [False, True, False]
    assert flagged[0].prev_ndcg_at_10 is None


def test_evaluation_view(spark):
    searches = spark.createDataFrame([("q", "t"), ("quiet", "t")], "id string, free_text string")
    fb = spark.createDataFrame([("q", 5, True), ("q", 2, False), ("q", 2, None)], "query_id string, rating int, booked boolean")
    assert [tuple(r) for r in E.evaluation_queries(searches, fb).collect()] == [("q", "t", 3, 3.0, 1)]
