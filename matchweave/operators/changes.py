"""Changes to the profile table: each computes the next snapshot from the current one.

Plain parquet has no MERGE, so a change is a full outer join of the snapshot with a
deduplicated change set (one row per key on both sides) and column-wise choices; the caller
writes the result to a new path.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import check_literal_size, contains_any

# Columns an upsert refreshes; all others, the id among them, keep their stored value.
REFRESHED = [
    "name", "gender", "ethnicity", "modalities", "specializations", "insurance_providers",
    "fee_min", "fee_max", "accepting_new_clients", "bio", "rating", "review_count",
    "profile_completeness", "embedding",
]


def last_wins(changes: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one latest in ``order``.

    A grouped ``max_by`` keeps one row per key and task before the shuffle, so a key with very
    many versions does not gather in one task.
    """
    rest = [c for c in changes.columns if c != key]
    return changes.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(key, "_last.*")


def upsert(base: DataFrame, changes: DataFrame, *, key: str = "source_url", order: str = "_seq",
           refreshed: Sequence[str] = REFRESHED, now: Column | None = None,
           touched: str = "last_updated") -> DataFrame:
    """Next snapshot: new keys are inserted whole, known keys refresh the listed columns only."""
    now = F.current_timestamp() if now is None else now
    latest = last_wins(changes, key, order).withColumn("_change", F.lit(True))
    stored = base.withColumn("_stored", F.lit(True))
    b, c = stored.alias("b"), latest.alias("c")
    joined = b.join(c, F.col(f"b.{key}") == F.col(f"c.{key}"), "full_outer")
    is_new, changed = F.col("b._stored").isNull(), F.col("c._change").isNotNull()

    def column(name: str) -> Column:
        new = F.col(f"c.{name}") if name in latest.columns else F.lit(None)
        old = F.col(f"b.{name}")
        if name == touched:
            return F.when(is_new, new).when(changed, now).otherwise(old)
        if name in refreshed:
            return F.when(changed, new).otherwise(old)
        return F.when(is_new, new).otherwise(old)

    return joined.select(*[column(n).alias(n) for n in base.columns])


def merge_into(changes: DataFrame, table: str, *, key: str = "source_url", order: str = "_seq",
               refreshed: Sequence[str] = REFRESHED) -> None:
    """The same upsert as MERGE, for tables of a catalog that supports it."""
    latest = last_wins(changes, key, order).drop(order).alias("c")
    updates = {n: F.col(f"c.{n}") for n in refreshed} | {"last_updated": F.current_timestamp()}
    (latest.mergeInto(table, F.col(f"{table}.{key}") == F.col(f"c.{key}"))
     .whenMatched().update(updates).whenNotMatched().insertAll().merge())


def _where(condition: Column, new: Column, name: str) -> Column:
    return F.when(condition, new).otherwise(F.col(name))


def soft_delete(base: DataFrame, keys: DataFrame, *, key: str = "id", now: Column | None = None) -> DataFrame:
    """Next snapshot with the listed rows inactive and closed; rows stay for their feedback."""
    now = F.current_timestamp() if now is None else now
    gone = keys.select(key).distinct().withColumn("_gone", F.lit(True))
    rows = base.join(gone, key, "left")
    hit = F.col("_gone").isNotNull()
    return rows.withColumns({
        "is_active": _where(hit, F.lit(False), "is_active"),
        "accepting_new_clients": _where(hit, F.lit(False), "accepting_new_clients"),
        "last_updated": _where(hit, now, "last_updated"),
    }).select(*base.columns)


# ---------------------------------------------------------------- audit
def one_per_key(found: DataFrame, key: str, order: str = "_seq") -> DataFrame:
    """``found`` with one row per key, so a join with it never multiplies rows.

    The row with the largest ``order`` wins if there is such a column, else the largest row by its
    columns in order: the answer is the same each time.
    """
    rest = [c for c in found.columns if c != key]
    rank = [c for c in rest if c == order] + [c for c in rest if c != order]
    best = found.groupBy(key).agg(F.max(F.struct(*rank)).alias("_best"))
    return best.select(key, *[F.col(f"_best.{c}").alias(c) for c in rest])


def page_closed(text: Column) -> Column:
    return contains_any(F.lower(text), vocab.NOT_ACCEPTING_PHRASES)


def audit_outcome(status: Column, text: Column, accepting: Column) -> Column:
    """deleted / deactivated / activated / ok / error for one fetched page."""
    closed = F.coalesce(page_closed(text), F.lit(False))
    return (F.when(status.isNull() | (status >= 500), "error")
            .when(status == 404, "deleted")
            .when((status == 200) & closed & accepting, "deactivated")
            .when((status == 200) & ~closed & ~accepting, "activated")
            .otherwise("ok"))


def audit(base: DataFrame, fetched: DataFrame, *, key: str = "source_url", now: Column | None = None
          ) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, outcome per active profile) from fetched pages (key, status, text).

    A key fetched more than once counts by its last row: see ``one_per_key``.
    """
    now = F.current_timestamp() if now is None else now
    pages = one_per_key(fetched, key).select(key, F.col("status").alias("_status"), F.col("text").alias("_text"))
    judged = base.join(pages, key, "left").withColumn("_outcome", F.when(
        F.col("is_active"), audit_outcome(F.col("_status"), F.col("_text"), F.col("accepting_new_clients"))))
    outcome = F.col("_outcome")
    deleted, closed = outcome == "deleted", outcome.isin("deleted", "deactivated")
    touched = outcome.isin("deleted", "deactivated", "activated")
    after = judged.withColumns({
        "is_active": _where(deleted, F.lit(False), "is_active"),
        "accepting_new_clients": F.when(closed, False).when(outcome == "activated", True)
        .otherwise(F.col("accepting_new_clients")),
        "last_updated": _where(touched, now, "last_updated"),
    }).select(*base.columns)
    outcomes = judged.where(outcome.isNotNull()).select(key, outcome.alias("outcome"))
    return after, outcomes


# ---------------------------------------------------------------- enrichment
def _empty(array: Column) -> Column:
    return F.coalesce(F.size(array) <= 0, F.lit(True))


def fill_missing(base: DataFrame, found: DataFrame, *, source: str, key: str = "id",
                 now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Fill gender and ethnicity where either is missing; new values win, gaps keep the old.

    ``found`` holds (key, ok, gender, ethnicity).  Returns the next snapshot and one of
    updated / partial / no_data / error per looked-at profile.
    """
    now = F.current_timestamp() if now is None else now
    new = one_per_key(found, key).select(key, F.col("ok").alias("_ok"), F.col("gender").alias("_g"),
                       F.col("ethnicity").alias("_e"))
    none = F.array().cast("array<string>")
    wanted = ((F.col("source") == source) & F.col("is_active")
              & (F.col("gender").isNull() | _empty(F.col("ethnicity"))))
    rows = base.join(new, key, "left").withColumn("_wanted", F.coalesce(wanted, F.lit(False)))
    gender = F.coalesce(F.nullif(F.col("_g"), F.lit("")), F.col("gender"))
    ethnicity = F.when(~_empty(F.col("_e")), F.col("_e")).otherwise(F.coalesce("ethnicity", none))
    rows = rows.withColumns({"_ng": gender, "_ne": ethnicity})
    same = F.col("_ng").eqNullSafe(F.col("gender")) & (F.col("_ne") == F.coalesce("ethnicity", none))
    outcome = (F.when(~F.coalesce("_ok", F.lit(False)), "error").when(same, "no_data")
               .when(F.col("_ng").isNotNull() & (F.size("_ne") > 0), "updated").otherwise("partial"))
    rows = rows.withColumn("_outcome", F.when(F.col("_wanted"), outcome))
    changed = F.col("_outcome").isin("updated", "partial")
    after = rows.withColumns({
        "gender": _where(changed, F.col("_ng"), "gender"),
        "ethnicity": _where(changed, F.col("_ne"), "ethnicity"),
        "last_updated": _where(changed, now, "last_updated"),
    }).select(*base.columns)
    return after, rows.where("_wanted").select(key, F.col("_outcome").alias("outcome"))


def overwrite_insurance(base: DataFrame, found: DataFrame, *, source: str, key: str = "id",
                        now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Replace insurers and the sliding flag of one source's active profiles.

    ``found`` holds (key, insurance_providers, sliding_scale); a profile without a row could
    not be read and is left as it is.
    """
    now = F.current_timestamp() if now is None else now
    new = one_per_key(found, key).select(key, F.col("insurance_providers").alias("_i"), F.col("sliding_scale").alias("_s"))
    rows = base.join(new, key, "left").withColumn(
        "_wanted", (F.col("source") == source) & F.col("is_active"))
    hit = F.col("_wanted") & F.col("_i").isNotNull()
    outcome = (F.when(F.col("_i").isNull(), "error")
               .when((F.size("_i") > 0) | F.col("_s"), "updated").otherwise("no_data"))
    after = rows.withColumns({
        "insurance_providers": _where(hit, F.col("_i"), "insurance_providers"),
        "sliding_scale": _where(hit, F.col("_s"), "sliding_scale"),
        "last_updated": _where(hit, now, "last_updated"),
    }).select(*base.columns)
    return after, rows.where("_wanted").select(key, outcome.alias("outcome"))


# ---------------------------------------------------------------- value corrections
def correct_value(col: Column, corrections: dict[str, str | None] = vocab.CITY_CORRECTIONS) -> Column:
    """Known bad values to their correction (or NULL); other values unchanged."""
    check_literal_size(corrections, "correction table")
    bad = [k for k in corrections]
    fixes = F.create_map(*[F.lit(x) for k, v in corrections.items() for x in (k, v)])
    return F.when(col.isin(bad), F.try_element_at(fixes, col)).otherwise(col)


def preview_corrections(df: DataFrame, column: str,
                        corrections: dict[str, str | None] = vocab.CITY_CORRECTIONS) -> DataFrame:
    """(bad, good, n): how many rows each correction would change."""
    hits = df.where(F.col(column).isin(list(corrections)))
    return (hits.groupBy(F.col(column).alias("bad")).agg(F.count("*").alias("n"))
            .select("bad", correct_value(F.col("bad"), corrections).alias("good"), "n"))


def remaining_dirty(df: DataFrame, column: str,
                    corrections: dict[str, str | None] = vocab.CITY_CORRECTIONS) -> DataFrame:
    return df.where(F.col(column).isin(list(corrections))).agg(F.count("*").alias("n"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count("*").alias("n"))
