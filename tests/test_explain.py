"""Explanation texts, word for word."""

from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.operators import explain as X

COLUMNS = ("modality_score double, semantic_score double, bm25_score double, quality_score double, location_score double, "
           "preferred_city string, city string, wanted array<struct<modality: string, weight: double>>, modalities array<string>, "
           "matched_modalities array<string>, concerns array<string>, bio string, session_formats array<string>, rating double, "
           "review_count int, profile_completeness double")
BASE = {"modality_score": 0.9, "semantic_score": 0.7, "bm25_score": 0.6, "quality_score": 0.5, "location_score": None,
        "preferred_city": None, "city": "Davis", "wanted": [("emdr", 1.0), ("somatic", 0.4), ("humanistic", 0.3)],
        "modalities": ["somatic", "emdr"], "matched_modalities": ["emdr"], "concerns": ["trauma", "grief"],
        "bio": "I have helped people heal for twenty years. More.", "session_formats": ["telehealth"], "rating": 4.8,
        "review_count": 12, "profile_completeness": 0.9}


def texts(spark, **over):
    df = spark.createDataFrame([tuple((BASE | over).values())], COLUMNS)
    return tuple(df.select(X.debug_explanation(), X.narrative()).first())


def test_breakdown(spark):
    debug, _ = texts(spark)
    assert debug == (
        "[SCORES] composite=0.745 | modality=0.900×0.4 | semantic=0.700×0.35 | bm25=0.600×0.15 | quality=0.500×0.1"
        " || [MODALITY] matched=emdr, somatic | missed=none | therapist has: emdr, somatic"
        " || [SEMANTIC] high — profile language closely mirrors query (normalized=0.700)"
        " || [BM25] high — strong exact-term overlap (normalized=0.600)"
        " || [QUALITY] 4.8★ (12 reviews) | completeness=0.90 | normalized=0.500")


def test_breakdown_with_city_and_no_overlap(spark):
    debug, _ = texts(spark, preferred_city="Fresno", location_score=1.0, modalities=[], matched_modalities=[], rating=None,
                     semantic_score=0.39, bm25_score=0.3)
    assert "[MODALITY] no modality overlap — query wants: emdr, somatic | therapist has: none listed" in debug
    assert "[SEMANTIC] low" in debug and "[BM25] moderate" in debug and "[QUALITY] no rating | " in debug
    assert debug.endswith("[LOCATION] preferred=Fresno | therapist=Davis | matched (boost=0.15×1)")


def test_narrative(spark):
    _, text = texts(spark)
    assert text == (
        "I have helped people heal for twenty years. They practise EMDR — approaches well suited to trauma and grief. "
        "EMDR is specifically designed for trauma — it helps the brain process distressing memories so they lose their emotional charge. "
        "Reading their bio, the themes and language closely reflect what you shared — the way they describe their work suggests a genuine fit. "
        "They are highly rated at 4.8★ across 12 client reviews.")


def test_narrative_branches(spark):
    _, partial = texts(spark, modality_score=0.6, modalities=["emdr"], concerns=[], semantic_score=0.65, bm25_score=0.1)
    assert "They practise EMDR, which aligns closely with what you described." in partial
    assert "They don't list somatic therapy, which was also flagged" in partial and "Their therapeutic style" in partial
    _, some = texts(spark, modality_score=0.2, matched_modalities=["emdr", "somatic"], semantic_score=0.1, bm25_score=0.1)
    assert some.startswith("They have some experience with EMDR and somatic therapy, though") and "This match is driven more" in some
    _, none = texts(spark, matched_modalities=[], semantic_score=0.4, bm25_score=0.6, rating=4.2, review_count=5)
    assert "(EMDR, somatic therapy), but" in none and "touches on several" in none and none.endswith("Rated 4.2★ from 5 reviews.")
    _, plain = texts(spark, matched_modalities=[], wanted=None, semantic_score=0.4, bm25_score=0.4, review_count=4)
    assert plain == "Ranked based on how closely their overall profile matches what you described."


def test_narrative_location(spark):
    def place(**over):
        return texts(spark, preferred_city="Fresno", rating=None, **over)[1]

    assert "They are based in Fresno, matching your location." in place(location_score=1.0)
    assert "They are based in Davis rather than Fresno, but offer online sessions" in place(location_score=0.0)
    assert place(location_score=0.0, city=None, session_formats=["in_person"]).endswith(
        "They are based in another city, not Fresno — confirm whether they see clients in your area before booking.")


def test_names(one):
    assert one(X.modality_name(F.lit("emdr"))) == "EMDR"
    assert one(X.modality_name(F.lit("12_step_facilitation"))) == "12 Step Facilitation"
    assert set(X.MODALITY_NAMES) == set(vocab.MODALITIES) == set(X.MODALITY_DESCRIPTIONS)
