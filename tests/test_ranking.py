"""Concern mapping, BM25, signals, composite: golden values."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from matchweave.operators import blocked
from matchweave.operators import rank as R
from matchweave.operators.bm25 import candidate_scores, corpus_topk
from matchweave.operators.concerns import (
    modality_weights, normalize_concern, tag_concerns, top_modalities)
from matchweave.sources.knowledge import Knowledge

DOCS = ["specializes in anxiety and panic attacks", "works with couples and family therapy",
        "treats depression and mood disorders"]


def scores(spark, query):
    pairs = spark.createDataFrame([(1, i) for i in range(3)], "query_id int, id int")
    queries = spark.createDataFrame([(1, query)], "query_id int, free_text string")
    docs = spark.createDataFrame(list(enumerate(DOCS)), "id int, document string")
    return [r.bm25 for r in candidate_scores(pairs, queries, docs).orderBy("id").collect()]


@pytest.mark.parametrize("query, expected", [
    ("anxiety panic", [1.911071, 0, 0]), ("and and", [0.260176, 0.260176, 0.281992]), ("", [0, 0, 0]),
    ("zzz", [0, 0, 0])])
def test_bm25_golden(spark, query, expected):
    assert scores(spark, query) == pytest.approx(expected, abs=1e-6)


def test_bm25_favours_shorter_text(spark):
    pairs = spark.createDataFrame([(1, 0), (1, 1)], "query_id int, id int")
    queries = spark.createDataFrame([(1, "anxiety")], "query_id int, free_text string")
    docs = spark.createDataFrame([(0, "anxiety"), (1, "anxiety " + "word " * 50)], "id int, document string")
    short, long = [r.bm25 for r in candidate_scores(pairs, queries, docs).orderBy("id").collect()]
    assert short > long > 0


def test_corpus_topk_equals_candidate_scores_over_everything(spark):
    queries = spark.createDataFrame([(1, "and family"), (2, "mood MOOD panic")], "query_id int, free_text string")
    docs = spark.createDataFrame(list(enumerate(DOCS)), "id int, document string")
    pairs = queries.select("query_id").join(docs.select("id"), how="cross")
    want = {(r.query_id, r.id): round(r.bm25, 6) for r in candidate_scores(pairs, queries, docs).collect() if r.bm25 > 0}
    for block in (100, 1):  # queries in one block, or each in its own
        top = corpus_topk(queries, docs, 10, query_key="query_id", query_text="free_text", doc_key="id",
                          doc_text="document", queries_per_block=block, items_per_slice=2)
        assert {(r.query_id, r.id): r.score for r in top.collect()} == pytest.approx(want)


@pytest.mark.parametrize("raw, expected", [
    ("Panic attacks", "panic_disorder"), ("Self esteem", "self_esteem"), ("severe social anxiety", "anxiety"),
    ("made_up_xyz", "made_up_xyz"), ("  Can't Sleep ", "insomnia"), ("!!!", "anxiety")])
def test_concern_normalisation(one, raw, expected):
    assert one(normalize_concern(F.lit(raw))) == expected


def weights(spark, concerns):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(concerns)], "query_id int, pos int, concern string")
    return modality_weights(rows, Knowledge().weights(spark))


def test_concern_weights(spark):
    got = {r.modality: r.weight for r in weights(spark, ["anxiety", "insomnia"]).collect()}
    assert got == pytest.approx({
        "cognitive_behavioral_therapy": 1.0, "acceptance_commitment_therapy": 0.9, "exposure_therapy": 0.9,
        "mindfulness_based": 0.8, "dialectical_behavior_therapy": 0.6, "emdr": 0.5, "somatic": 0.5,
        "humanistic": 0.4, "cbt_insomnia": 1.0})
    assert weights(spark, ["made_up_xyz"]).count() == 0
    top = [r.modality for r in top_modalities(weights(spark, ["anxiety"]), 3).orderBy("rank").collect()]
    assert top == ["cognitive_behavioral_therapy", "acceptance_commitment_therapy", "exposure_therapy"]


def test_weighted_concerns_are_rescaled(spark):
    rows = spark.createDataFrame([(1, 0, "anxiety", 0.5)], "query_id int, pos int, concern string, concern_weight double")
    got = {r.modality: r.weight for r in modality_weights(rows, Knowledge().weights(spark)).collect()}
    assert got["cognitive_behavioral_therapy"] == 1.0 and got["humanistic"] == pytest.approx(0.4)
    zero = rows.withColumn("concern_weight", F.lit(0.0))
    assert {r.weight for r in modality_weights(zero, Knowledge().weights(spark)).collect()} == {None}


def test_concern_tags(one):
    assert one(tag_concerns(F.lit("I can't sleep, and the burnout... social anxiety!"))) == [
        "anxiety", "social_anxiety", "stress_burnout", "insomnia"]
    assert one(tag_concerns(F.lit("glossary of losses"))) == []


WANTED = [("cognitive_behavioral_therapy", 1.0), ("acceptance_commitment_therapy", 0.9), ("exposure_therapy", 0.9),
          ("mindfulness_based", 0.8), ("dialectical_behavior_therapy", 0.6), ("emdr", 0.5), ("somatic", 0.5),
          ("humanistic", 0.4)]


def test_modality_match(spark):
    row = spark.createDataFrame(
        [(WANTED, ["mindfulness_based", "cognitive_behavioral_therapy", "acceptance_commitment_therapy", "somatic"])],
        "wanted array<struct<modality: string, weight: double>>, offered array<string>")
    three = F.slice("offered", 1, 3)
    out = row.select(R.modality_match(F.col("wanted"), three).alias("s"),
                     R.matched_modalities(F.col("wanted"), F.col("offered")).alias("m"),
                     R.modality_match(F.lit(None).cast("array<struct<modality: string, weight: double>>"), three).alias("n")
                     ).first()
    assert out.s == pytest.approx(2.7 / 5.6) and out.n == 0.0
    assert out.m == ["cognitive_behavioral_therapy", "acceptance_commitment_therapy", "mindfulness_based"]


@pytest.mark.parametrize("sims, expected", [([0.4, 0.2], 0.65), ([-0.3], 0.5), ([], 1.0)])
def test_corroboration(one, sims, expected):
    assert one(R.corroboration(F.lit(sims).cast("array<double>") if sims else F.array().cast("array<double>"))) == pytest.approx(expected)


@pytest.mark.parametrize("n, expected", [(5, 1), (6, 0.946395), (10, 0.810714), (20, 0.663194)])
def test_breadth(one, n, expected):
    assert one(R.breadth_penalty(F.lit(n))) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize("rating, reviews, completeness, expected", [
    (4.9, 47, 0.95, 0.870703), (None, 0, 0.8, 0.32), (4.8, 200, 0.9, 0.93)])
def test_quality(one, rating, reviews, completeness, expected):
    got = one(R.quality(F.lit(rating).cast("double"), F.lit(reviews), F.lit(completeness)))
    assert got == pytest.approx(expected, abs=1e-6)


def test_minmax(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.5), (1, 4.0), (2, 7.0), (2, 7.0)], "query_id int, v double")
    got = [r[0] for r in df.select(R.minmax("v").alias("n"), "query_id", "v").orderBy("query_id", "v").collect()]
    assert got == [0, 0.5, 1, 0.5, 0.5]


def test_composite(one):
    values = [F.lit(v) for v in (1.0, 0.5, 0.25, 0.5)]
    assert one(R.composite(F.lit(None).cast("string"), *values, F.lit(None).cast("double"))) == pytest.approx(0.6625)
    assert one(R.composite(F.lit("Fresno"), *values, F.lit(1.0))) == pytest.approx(0.7175)


def test_rank_ties_follow_distance(spark):
    df = spark.createDataFrame([(1, "a", 0.5, 0.3), (1, "b", 0.5, 0.1), (1, "c", 0.9, 0.9)],
                               "query_id int, id string, composite_score double, distance double")
    assert [r.id for r in R.rank(df).orderBy("rank").collect()] == ["c", "b", "a"]


def test_labels(one):
    fits = [one(R.fit_label(F.lit(r))) for r in (1, 2, 3, 4, 6, 7)]
    assert fits == ["Strong fit", "Good fit", "Good fit", "Decent fit", "Decent fit", "Possible match"]
    assert [one(R.score_band(F.lit(v))) for v in (0.8, 0.6, 0.4, 0.39)] == ["Excellent", "Good", "Moderate", "Low"]
    assert math.isclose(one(R.location(F.lit("FRESNO"), F.lit("fresno"))), 1.0)
    assert one(R.location(F.lit(None).cast("string"), F.lit("fresno"))) == 0.0


def test_keyword_scores_take_texts_in_bounded_parts(spark, monkeypatch):
    """The words of a slice are not held at once, and the cuts change nothing; slices are bounded by characters."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9))) for i in range(60)], "id int, document string")
    queries = spark.createDataFrame([(1, "w1 w2 w3"), (2, "w5")], "query_id int, free_text string")
    run = lambda: sorted(map(tuple, corpus_topk(queries, docs, 5, query_key="query_id", query_text="free_text", doc_key="id", doc_text="document").collect()))
    whole = run()
    held, add = [], blocked._KeywordState._add
    monkeypatch.setattr(blocked, "CHARS_AT_ONCE", 40)
    monkeypatch.setattr(blocked._KeywordState, "_add", lambda self, items: (held.append(items["_text"].map(len).sum()), add(self, items)))
    state = blocked._KeywordState(pd.DataFrame({"q": [1], "_k": [5], "_avgdl": [4.0], "_terms": [["w1"]], "_weights": [[1.0]]}), "q", "id", 6, 1.5, 0.75)
    items = pd.DataFrame({"id": range(40), "_text": ["w1 w2 w3"] * 40})
    state.add(items)
    assert len(held) >= 8 and max(held) <= 48 and sum(held) == 320 and state.result()["id"].tolist() == [0, 1, 2, 3, 4]
    monkeypatch.undo()
    monkeypatch.setattr(blocked, "CHARS_PER_SLICE", 50)
    assert run() == whole


def test_concern_text_is_normalised_once(spark):
    rows = spark.createDataFrame([("Panic-attacks,  insomnia!",), (None,), ("none",)], "t string")
    got = rows.select(tag_concerns(F.col("t"), Knowledge({"insomnia": {}, "grief": {}}, {"panic attacks": "anxiety"})).alias("c"))
    assert [r.c for r in got.collect()] == [["insomnia", "anxiety"], None, []]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") == 1
