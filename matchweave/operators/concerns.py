"""From concerns in a search to weighted modalities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchweave.functions.text import all_tags, slugify, strip
from matchweave.sources.knowledge import Knowledge


def normalize_concern(concern: Column, knowledge: Knowledge = Knowledge()) -> Column:
    """Alias, else slug, else the first known key inside the slug or around it, else unchanged."""
    aliases = F.create_map(*[F.lit(x) for kv in knowledge.aliases.items() for x in kv]) \
        if knowledge.aliases else F.create_map().cast("map<string,string>")
    keys = F.array(*[F.lit(k) for k in knowledge.concerns])
    slug = slugify(concern)
    partial = F.filter(keys, lambda k: F.contains(slug, k) | F.contains(k, slug))
    return F.coalesce(
        F.try_element_at(aliases, strip(F.lower(concern))),
        F.when(F.array_contains(keys, slug), slug),
        F.get(partial, F.lit(0)),
        concern)


def tag_concerns(text: Column, knowledge: Knowledge = Knowledge()) -> Column:
    """Concerns whose key (as words) or alias is named in the text, in table order."""
    padded = F.concat(F.lit(" "), F.lower(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}']+", " "))), F.lit(" "))
    phrases = [(k.replace("_", " "), k) for k in knowledge.concerns] + list(knowledge.aliases.items())
    return all_tags(padded, [(f" {phrase} ", concern) for phrase, concern in phrases])


def modality_weights(concerns: DataFrame, weights: DataFrame, *, key: str = "query_id",
                     knowledge: Knowledge = Knowledge()) -> DataFrame:
    """(query, modality, weight, ord): strongest weighted strength per modality, top one scaled to 1.

    ``concerns`` has one row per (query, concern) with optional ``concern_weight`` and position
    ``pos``; ``weights`` is the knowledge table.  ``ord`` is the order in which a query's
    concerns first name a modality.  A query has at most as many rows here as the table has
    modalities, so the window by query is small.
    """
    rows = concerns.withColumn("concern", normalize_concern(F.col("concern"), knowledge))
    if "concern_weight" not in rows.columns:
        rows = rows.withColumn("concern_weight", F.lit(1.0))
    if "pos" not in rows.columns:
        rows = rows.withColumn("pos", F.lit(0))
    best = (rows.join(weights, "concern").groupBy(key, "modality").agg(
        F.max(F.col("strength") * F.col("concern_weight")).alias("weight"),
        F.min(F.struct("pos", "mod_ord")).alias("ord")))
    top = F.max("weight").over(Window.partitionBy(key))
    return best.withColumn("weight", F.try_divide(F.col("weight"), top))


def wanted_modalities(concerns: DataFrame, weights: DataFrame, *, key: str = "query_id",
                      knowledge: Knowledge = Knowledge()) -> DataFrame:
    """(query, wanted): one array of (modality, weight) per query, in naming order."""
    rows = modality_weights(concerns, weights, key=key, knowledge=knowledge)
    packed = F.array_sort(F.collect_list(F.struct("ord", "modality", "weight")))
    return rows.groupBy(key).agg(F.transform(
        packed, lambda e: F.struct(e["modality"].alias("modality"), e["weight"].alias("weight")))
        .alias("wanted"))


def top_modalities(weighted: DataFrame, k: int = 5, *, key: str = "query_id") -> DataFrame:
    """The k strongest modalities per query, ties by name."""
    w = Window.partitionBy(key).orderBy(F.col("weight").desc(), "modality")
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
