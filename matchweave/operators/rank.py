"""Ranking signals and their combination, on (query, candidate) rows.

Rows are the bounded candidate lists of the searches, so windows by query are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave import vocab

HIT_WEIGHT = 0.5
TYPICAL_BREADTH = 5


# ---------------------------------------------------------------- modality match
# ``wanted`` is ARRAY<STRUCT<modality, weight>>, ``offered`` ARRAY<STRING>.
def _total(entries: Column) -> Column:
    return F.aggregate(entries, F.lit(0.0).cast("double"), lambda acc, e: acc + e["weight"])


def modality_match(wanted: Column, offered: Column) -> Column:
    """Weight of offered wanted modalities as a share of all wanted weight."""
    hits = F.filter(wanted, lambda e: F.array_contains(offered, e["modality"]))
    share = F.try_divide(_total(hits), _total(wanted))
    return F.least(F.lit(1.0), F.coalesce(share, F.lit(0.0)))


def matched_modalities(wanted: Column, offered: Column) -> Column:
    """Offered modalities that are strongly wanted, in wanted order."""
    strong = F.filter(
        wanted, lambda e: F.array_contains(offered, e["modality"]) & (e["weight"] > HIT_WEIGHT))
    return F.coalesce(F.transform(strong, lambda e: e["modality"]), F.array().cast("array<string>"))


def corroboration(similarities: Column) -> Column:
    """0.5 to 1 by how well matched modalities show in the profile's vector; 1 if none matched."""
    n = F.size(similarities)
    total = F.aggregate(similarities, F.lit(0.0).cast("double"), lambda acc, s: acc + s)
    mean = F.try_divide(total, n)
    return (F.when(F.coalesce(n, F.lit(0)) <= 0, F.lit(1.0))
            .otherwise(F.lit(0.5) + F.lit(0.5) * F.greatest(F.lit(0.0), mean)))


def breadth_penalty(n_offered: Column) -> Column:
    return (F.when(n_offered <= TYPICAL_BREADTH, F.lit(1.0))
            .otherwise(F.log(F.lit(float(TYPICAL_BREADTH + 3))) / F.log(n_offered + 3)))


def quality(rating: Column, reviews: Column, completeness: Column) -> Column:
    """Rating damped by its number of reviews, plus completeness of the profile."""
    confidence = F.least(F.lit(1.0), F.log1p(F.coalesce(reviews, F.lit(0))) / F.log1p(F.lit(100.0)))
    rated = F.coalesce((rating.cast("double") - 1) / 4 * confidence, F.lit(0.0))
    return rated * 0.6 + completeness.cast("double") * 0.4


def location(city: Column, preferred: Column) -> Column:
    """1 in the preferred city, 0 elsewhere; NULL if no city is preferred."""
    same = F.lower(F.coalesce(city, F.lit(""))) == F.lower(preferred)
    return F.when(F.coalesce(preferred, F.lit("")) != "", F.when(same, 1.0).otherwise(0.0))


def minmax(value: str, key: str = "query_id") -> Column:
    """Min-max over a query's candidates; all tied gives 0.5."""
    w = Window.partitionBy(key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return F.when(hi == lo, F.lit(0.5)).otherwise(F.try_divide(F.col(value) - lo, hi - lo))


def composite(preferred: Column, modality: Column, semantic: Column, bm25: Column, qual: Column,
              loc: Column) -> Column:
    """Weighted sum of normalised signals; a preferred city brings in the location signal."""
    given = F.coalesce(preferred, F.lit("")) != ""

    def total(weights: dict[str, float]) -> Column:
        return (modality * weights["modality"] + semantic * weights["semantic"]
                + bm25 * weights["bm25"] + qual * weights["quality"]
                + F.coalesce(loc, F.lit(0.0)) * weights["location"])

    return F.when(given, total(vocab.WEIGHTS_WITH_CITY)).otherwise(total(vocab.WEIGHTS))


SIGNALS = ["modality_score", "semantic_score", "bm25_score", "quality_score"]


def score(pairs: DataFrame, *, key: str = "query_id", preferred: str = "preferred_city") -> DataFrame:
    """Add normalised signals and the composite to rows with the raw signal columns.

    Signals are normalised over the query's candidates, combined, and rounded to 4 places only
    at the end.
    """
    raw = pairs.withColumns({s: minmax(f"raw_{s}", key) for s in SIGNALS})
    raw = raw.withColumn("location_score", location(F.col("city"), F.col(preferred)))
    total = composite(F.col(preferred), *[F.col(s) for s in SIGNALS], F.col("location_score"))
    return raw.withColumn("composite_score", F.round(total, 4))


def rank(scored: DataFrame, *, key: str = "query_id", item: str = "id",
         limit: int | None = None) -> DataFrame:
    """Rank by composite, ties in vector order; optionally keep the first ``limit``."""
    w = Window.partitionBy(key).orderBy(F.col("composite_score").desc(), "distance", item)
    out = scored.withColumn("rank", F.row_number().over(w))
    return out if limit is None else out.where(F.col("rank") <= limit)


def fit_label(rank_: Column) -> Column:
    return (F.when(rank_ <= 1, "Strong fit").when(rank_ <= 3, "Good fit")
            .when(rank_ <= 6, "Decent fit").otherwise("Possible match"))


def score_band(value: Column) -> Column:
    return (F.when(value >= 0.8, "Excellent").when(value >= 0.6, "Good")
            .when(value >= 0.4, "Moderate").otherwise("Low"))
