"""Batch search: a table of searches against a table of profiles, ranked in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions import vectors as V
from matchweave.operators import rank as R
from matchweave.operators.bm25 import candidate_scores
from matchweave.operators.clean import (
    bio_excerpt, coerce_profiles, fee_label, has_content, merge_filters, search_document)
from matchweave.operators.concerns import wanted_modalities
from matchweave.operators.embed import Encoder, query_text, text_vectors
from matchweave.operators.explain import MODALITY_DESCRIPTIONS, debug_explanation, narrative
from matchweave.operators.filters import query_demands
from matchweave.operators.nearest import candidate_topk
from matchweave.operators.relax import choose_level, ladder_counts, searchable
from matchweave.sources.knowledge import Knowledge
from matchweave.sources.tables import materialize


def description_vectors(spark: SparkSession, encoder: Encoder | None = None, stored: DataFrame | None = None) -> DataFrame:
    """(modality, embedding): the vector of each modality's description."""
    rows = spark.createDataFrame(list(MODALITY_DESCRIPTIONS.items()), "modality string, text string")
    vectors = text_vectors(rows, stored=stored, encoder=encoder).where(F.size("embedding") > 0)
    return rows.withColumn("text_hash", F.sha2("text", 256)).join(vectors, "text_hash").select(
        "modality", F.col("embedding").cast("array<double>").alias("embedding"))


def ask(requests: DataFrame, encoder: Encoder | None = None, stored: DataFrame | None = None, *,
        explicit: str = "explicit", inferred: str = "inferred") -> DataFrame:
    """Searches from raw requests, ready for ``candidates``.

    Filters given explicitly override inferred ones (structs; where there are none, the filter columns stay), requests
    without text and filters are left out, and a request without an embedding gets the vector of its text.
    A text that cannot be encoded leaves the embedding null: such a search is ranked by its other signals.
    """
    if explicit in requests.columns:
        requests = merge_filters(requests, explicit, inferred)
    rows = requests.where(has_content()).withColumn("_text", query_text(F.col("free_text")))
    if "embedding" not in rows.columns:
        rows = rows.withColumn("embedding", F.lit(None).cast("array<float>"))
    vectors = text_vectors(rows.where(F.col("embedding").isNull()), "_text", stored=stored, encoder=encoder)
    vectors = vectors.where(F.size("embedding") > 0).withColumnRenamed("embedding", "_vector")
    hashed = F.when(F.col("embedding").isNull(), F.sha2("_text", 256))
    return rows.withColumn("text_hash", hashed).join(vectors, "text_hash", "left").withColumn(
        "embedding", F.coalesce("embedding", "_vector")).drop("text_hash", "_text", "_vector")


def add_similarities(rows: DataFrame, descriptions: DataFrame, output: str = "similarities") -> DataFrame:
    """Add the similarities of each row's vector to the descriptions of its matched modalities.

    ``rows`` (query_id, id, embedding, matched_modalities, ...); ``descriptions`` (modality,
    embedding), unit vectors.  Of descriptions that name the same modality the greatest vector counts.
    """
    described = descriptions.groupBy("modality").agg(F.max("embedding").alias("_d"))
    pairs = rows.select("query_id", "id", "embedding", F.explode("matched_modalities").alias("modality"))
    similarity = V.dot(F.col("embedding"), F.col("_d")) / (V.norm(F.col("embedding")) + V.EPSILON)
    lists = (pairs.join(described, "modality").groupBy("query_id", "id")
             .agg(F.array_sort(F.collect_list(similarity)).alias(output)))
    return rows.join(lists, ["query_id", "id"], "left").withColumn(
        output, F.coalesce(output, F.array().cast("array<double>")))


def candidates(queries: DataFrame, profiles: DataFrame, *, home_state: str = "CA",
               **options) -> tuple[DataFrame, DataFrame]:
    """(searches with their level and note, candidate rows) after filters and relaxation.

    Both are used several times further on and are small (one row per search, and a bounded
    list per search), so they are written once.
    """
    pool = searchable(profiles, home_state)
    counts = ladder_counts(queries, pool)
    chosen = materialize(choose_level(queries, counts), "searches")
    asked = chosen.withColumns({
        "demands": query_demands(), "max_budget": F.coalesce("max_budget", F.lit(0))})
    pairs = candidate_topk(asked, pool, **options)
    return chosen, materialize(pairs.select("query_id", "id", "distance"), "candidates")


def search(queries: DataFrame, profiles: DataFrame, descriptions: DataFrame, weights: DataFrame, *,
           home_state: str = "CA", limit: int = vocab.RESULT_LIMIT,
           knowledge: Knowledge = Knowledge(), **options) -> DataFrame:
    """Ranked top results of every search, with all signals and the search's note.

    ``queries`` follow ``QUERY_SCHEMA``; a search with no admissible profile gives no rows here
    (its note is in ``candidates``).
    """
    chosen, pairs = candidates(queries, profiles, home_state=home_state, **options)
    return rank_candidates(chosen, pairs, profiles, descriptions, weights, limit=limit,
                           knowledge=knowledge)


def rank_candidates(chosen: DataFrame, pairs: DataFrame, profiles: DataFrame,
                    descriptions: DataFrame, weights: DataFrame, *,
                    limit: int | None = vocab.RESULT_LIMIT,
                    knowledge: Knowledge = Knowledge()) -> DataFrame:
    """Score and rank bounded candidate lists ``(query_id, id, distance)``.

    The profiles are read once for the candidates among them; everything after works on those.
    """
    offered = coerce_profiles(profiles).withColumn("document", search_document())
    offered = materialize(offered.join(pairs.select("id").distinct(), "id", "left_semi"), "offered")
    concerns = chosen.select("query_id", F.posexplode("concerns").alias("pos", "concern"))
    wanted = wanted_modalities(concerns, weights, knowledge=knowledge)
    asked = (chosen.select("query_id", "free_text", "concerns", F.col("city").alias("preferred_city"),
                           "note", "filtered_count").join(wanted, "query_id", "left"))
    keyword = candidate_scores(pairs, chosen, offered)
    rows = (pairs.join(keyword, ["query_id", "id"]).join(asked, "query_id")
            .join(offered.drop("document"), "id"))
    rows = with_signals(rows, descriptions)
    return R.rank(R.score(rows), limit=limit).withColumn("fit", R.fit_label(F.col("rank")))


def with_signals(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Raw modality, semantic, keyword and quality signals of candidate rows."""
    wanted, offered = F.col("wanted"), F.col("modalities")
    rows = rows.withColumn("matched_modalities", R.matched_modalities(wanted, offered))
    rows = add_similarities(rows, descriptions, "_seen")
    modality = (R.modality_match(wanted, offered) * R.corroboration(F.col("_seen"))
                * R.breadth_penalty(F.size(offered)))
    return rows.withColumns({
        "raw_modality_score": modality,
        "raw_semantic_score": F.lit(1.0) - F.col("distance"),
        "raw_bm25_score": F.col("bm25"),
        "raw_quality_score": R.quality(F.col("rating"), F.col("review_count"),
                                       F.col("profile_completeness")),
    }).drop("_seen")


def result_columns() -> list[Column]:
    """The 18 fields of a result row."""
    return [
        F.col("id").alias("therapist_id"), F.col("name"), F.col("credentials"), F.col("city"),
        F.col("session_formats"), F.col("insurance_providers").alias("accepts_insurance"),
        F.col("sliding_scale"),
        fee_label(F.col("fee_min"), F.col("fee_max"), F.col("sliding_scale")).alias("fee_range"),
        F.col("matched_modalities"), bio_excerpt(F.col("bio")).alias("bio_excerpt"),
        F.col("source_url"), F.col("composite_score"),
        *[F.round(s, 4).alias(s) for s in ("modality_score", "semantic_score", "bm25_score")],
        F.round("quality_score", 4).alias("rating_score"),
        F.col("score_explanation").alias("match_explanation"), F.col("narrative_explanation"),
    ]


def results(ranked: DataFrame) -> DataFrame:
    """Result rows with both explanation texts; meant for the final top results."""
    explained = ranked.withColumns({"score_explanation": debug_explanation(),
                                    "narrative_explanation": narrative()})
    return explained.select("query_id", "rank", "fit", *result_columns())


def search_log(chosen: DataFrame, ranked: DataFrame) -> DataFrame:
    """One log row per search: ordered result ids and candidate counts.

    At most ``RESULT_LIMIT`` ids are gathered per search.
    """
    ids = ranked.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda e: e["id"].cast("string"))
        .alias("result_ids"))
    return chosen.join(ids, "query_id", "left").select(
        F.col("query_id").alias("id"), "free_text",
        F.to_json(F.struct("concerns")).alias("extracted_intent"),
        F.coalesce("result_ids", F.array().cast("array<string>")).alias("result_ids"),
        F.col("filtered_count").alias("total_candidates"), "filtered_count",
        F.lit(0).alias("latency_ms"), F.lit(0).alias("llm_tokens"), F.lit(False).alias("cache_hit"))
