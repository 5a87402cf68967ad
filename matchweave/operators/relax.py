"""Progressive relaxation of search criteria, decided for all searches in one pass.

A profile becomes admissible for a search at the highest level among the criteria it fails.
Counting profiles per level therefore answers every step of the ladder at once: the chosen
step is the first level of a criterion the search sets at which enough profiles are in.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import and_list, title
from matchweave.operators.filters import (
    LEVEL, RELAX_ORDER, SAFETY_LEVEL, fee_floor, profile_facets, query_demands, set_levels)

# Bounds of one cell of the grid that counts: sets of criteria in a row, and signatures.
CRITERIA_PER_BLOCK = 256
SIGNATURES_PER_SLICE = 50_000

GENERIC_NOTE = (
    "We couldn't find enough therapists with your preferences, so we broadened your search to "
    "show you the best matches across California.")
NOTE_START = (
    "We couldn't find enough therapists with all your preferences, so we broadened your search "
    "a little by removing ")


def searchable(profiles: DataFrame, home_state: str = "CA") -> DataFrame:
    """Profiles any search may return, with their facets: plain predicates that reach the scan."""
    open_ = profiles.where(
        (F.col("state") == home_state) & F.col("accepting_new_clients") & F.col("embedding").isNotNull())
    return open_.withColumns({"facets": profile_facets(), "fee_floor": fee_floor()})


def signatures(searchable_profiles: DataFrame) -> DataFrame:
    """Distinct facet combinations with their number of profiles."""
    return searchable_profiles.groupBy("facets", "fee_floor").agg(F.count("*").alias("n"))


def need(demands: Column, max_budget: Column, facets: Column, floor: Column) -> Column:
    """The level at which a profile becomes admissible: the highest among the criteria it fails; NULL: never."""
    start = F.when((max_budget != 0) & (floor > max_budget), LEVEL["budget"]).otherwise(0)
    never = F.lit(SAFETY_LEVEL + 1)
    worst = F.aggregate(demands, start, lambda level, d: F.when(F.arrays_overlap(d["any_of"], facets), level).otherwise(
        F.greatest(level, F.when(d["level"] == 0, never).otherwise(d["level"]))))
    return F.nullif(worst, never)


def ladder_counts(queries: DataFrame, profiles: DataFrame, *, key: str = "query_id", criteria_per_block: int = CRITERIA_PER_BLOCK,
                  signatures_per_slice: int = SIGNATURES_PER_SLICE) -> DataFrame:
    """(query_id, need, n) for queries with criteria columns and ``searchable`` profiles.

    Searches with the same criteria have the same counts, and so have profiles with the same facets: distinct sets of
    criteria, gathered in blocks of bounded size, meet slices of the distinct signatures, and only counts per
    set and level leave a cell.
    """
    asked = queries.select(key, query_demands().alias("demands"),
                           F.coalesce("max_budget", F.lit(0)).alias("max_budget"))
    asked = asked.withColumn("_criteria", F.to_json(F.struct("demands", "max_budget")))
    distinct = asked.drop(key).dropDuplicates(["_criteria"])
    n_blocks = max(1, math.ceil(distinct.count() / criteria_per_block))
    kinds = signatures(profiles)
    n_slices = max(profiles.sparkSession.sparkContext.defaultParallelism, math.ceil(kinds.count() / signatures_per_slice))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = distinct.groupBy(F.pmod(F.xxhash64("_criteria"), F.lit(n_blocks)).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("_criteria", "demands", "max_budget")).alias("_sets"))
    left = kinds.withColumn("_slice", F.pmod(F.xxhash64("facets", "fee_floor"), F.lit(n_slices)).cast("int")).withColumn("_block", every(n_blocks))
    right = blocks.withColumn("_slice", every(n_slices))
    met = left.join(right, ["_block", "_slice"])
    each = met.select("n", F.inline(F.transform("_sets", lambda c: F.struct(
        c["_criteria"].alias("_criteria"), need(c["demands"], c["max_budget"], F.col("facets"), F.col("fee_floor")).alias("need")))))
    counts = each.where(F.col("need").isNotNull()).groupBy("_criteria", "need").agg(F.sum("n").alias("n"))
    return asked.select(key, "_criteria").join(counts, "_criteria").select(key, "need", "n")


def choose_level(queries: DataFrame, counts: DataFrame, *, key: str = "query_id",
                 minimum: int = vocab.MIN_CANDIDATES) -> DataFrame:
    """Queries with ``level``, ``filtered_count``, ``top_k``, ``relaxed`` and ``note``.

    ``filtered_count`` is the number of candidates the search fetches, so it is capped by the
    fetch limit as the top-k is.
    """
    per_level = counts.groupBy(key).agg(*[
        F.sum(F.when(F.col("need") <= level, F.col("n"))).alias(f"_n{level}")
        for level in range(SAFETY_LEVEL + 1)])
    rows = queries.join(per_level, key, "left")
    have = F.array(*[F.coalesce(f"_n{level}", F.lit(0)) for level in range(SAFETY_LEVEL + 1)])
    rows = rows.withColumn("_have", have).withColumn("_set", set_levels())
    enough = F.filter("_set", lambda v: F.get("_have", v) >= minimum)
    level = (F.when(F.get("_have", F.lit(0)) >= minimum, F.lit(0))
             .otherwise(F.coalesce(F.get(enough, F.lit(0)), F.lit(SAFETY_LEVEL))))
    rows = rows.withColumn("level", level.cast("int"))
    rows = rows.withColumn("top_k", F.when(F.col("level") == SAFETY_LEVEL, vocab.FALLBACK_LIMIT)
                           .otherwise(vocab.CANDIDATE_LIMIT).cast("int"))
    return rows.withColumns({
        "filtered_count": F.least(F.get("_have", F.col("level")), F.col("top_k")).cast("bigint"),
        "relaxed": F.col("level") > 0,
        "note": relaxation_note(F.col("level")),
    }).drop("_have", "_set", *[f"_n{v}" for v in range(SAFETY_LEVEL + 1)])


def dropped_labels(level: Column, q=F.col) -> Column:
    """Texts for the set criteria given up at or before ``level``, in order."""
    texts = {
        "budget": F.format_string("your budget limit ($%d)", q("max_budget")),
        "format": F.lit("your session format preference"),
        "insurance": F.concat(F.lit("your insurance filter ("),
                              title(F.replace(q("insurance"), F.lit("_"), F.lit(" "))), F.lit(")")),
        "city": F.concat(F.lit("your location filter ("), q("city"), F.lit(")")),
        "gender": F.concat(F.lit("your gender preference ("), q("preferred_gender"), F.lit(")")),
        "ethnicity": F.concat(F.lit("your ethnicity preference ("), q("preferred_ethnicity"), F.lit(")")),
        "language": F.concat(F.lit("your language preference ("), title(q("preferred_language")), F.lit(")")),
    }
    is_set = set_levels(q)
    return F.array_compact(F.array(*[
        F.when((level >= LEVEL[n]) & F.array_contains(is_set, LEVEL[n]), texts[n]) for n in RELAX_ORDER]))


def relaxation_note(level: Column, q=F.col) -> Column:
    labels = dropped_labels(level, q)
    return (F.when(level == 0, F.lit(""))
            .when(F.size(labels) == 0, F.lit(GENERIC_NOTE))
            .otherwise(F.concat(F.lit(NOTE_START), and_list(labels), F.lit("."))))
