"""Data-quality checks on the profile table.

All single-table checks are conditional sums of one aggregate, so the table is read once;
only duplicates, per-group shares and orphans need an aggregate or join of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.vectors import norm

SCHEMA, QUALITY = "Schema / Constraint Validation", "Data Quality"
RULES, SANITY = "Business Rules", "Distribution / Sanity"
REQUIRED = ["name", "state", "source_url", "source", "accepting_new_clients", "is_active"]
BOUNDS = {"latitude": (32.5, 42.0), "longitude": (-124.5, -114.1)}


def outside_domain(array: Column, domain: Sequence[str]) -> Column:
    """An array holds a value outside its domain."""
    allowed = F.array(*[F.lit(d) for d in domain])
    return F.coalesce(F.size(F.array_except(array, allowed)) > 0, F.lit(False))


def violations(as_of: Column, dim: int, home_state: str) -> dict[str, tuple[str, str, Column]]:
    """check name -> (category, severity, condition of a violating row)."""
    fee_min, fee_max = F.col("fee_min"), F.col("fee_max")
    vector = F.col("embedding")
    future = F.col("scraped_at") > F.timestamp_seconds(F.unix_seconds(as_of) + 60)
    out = {f"not_null_{c}": (SCHEMA, "FAIL", F.col(c).isNull()) for c in REQUIRED}
    out |= {
        "fee_min_lte_fee_max": (SCHEMA, "FAIL", fee_min > fee_max),
        "rating_range": (SCHEMA, "FAIL", (F.col("rating") < 0) | (F.col("rating") > 5)),
        "value_domains": (SCHEMA, "FAIL",
                          outside_domain(F.col("modalities"), vocab.MODALITIES)
                          | outside_domain(F.col("session_formats"), vocab.SESSION_FORMATS)
                          | outside_domain(F.col("insurance_providers"), vocab.INSURERS)),
        "bio_min_length": (QUALITY, "FAIL", F.length(F.trim("bio")) < 20),
        "profile_completeness_range": (QUALITY, "FAIL", (F.col("profile_completeness") < 0)
                                       | (F.col("profile_completeness") > 1)),
        "no_negative_fees": (QUALITY, "FAIL", (fee_min < 0) | (fee_max < 0)),
        "fees_not_excessive": (QUALITY, "WARN", (fee_min > 1000) | (fee_max > 1000)),
        "source_url_format": (QUALITY, "FAIL", ~F.startswith(F.col("source_url"), F.lit("http"))),
        "no_future_timestamps": (QUALITY, "WARN", future),
        "all_home_state": (RULES, "FAIL", F.col("state") != home_state),
        "embedding_dimensions": (RULES, "FAIL", vector.isNotNull() & (F.size(vector) != dim)),
        "no_zero_embeddings": (RULES, "FAIL", vector.isNotNull() & (norm(vector) < 0.01)),
        "coordinates_in_bounds": (RULES, "WARN", ~(F.col("latitude").between(*BOUNDS["latitude"])
                                                  & F.col("longitude").between(*BOUNDS["longitude"]))),
    }
    return out


def single_pass(profiles: DataFrame, as_of: Column, *, dim: int, home_state: str = "CA") -> DataFrame:
    """One row: violation counts of every single-table check and the totals ratios need."""
    checks = violations(as_of, dim, home_state)
    no_tags = F.coalesce(F.size("modalities") <= 0, F.lit(True))
    active = F.col("is_active")
    return profiles.agg(
        *[F.count(F.when(bad, 1)).alias(name) for name, (_, _, bad) in checks.items()],
        F.count("*").alias("total"), F.count(F.when(active, 1)).alias("active"),
        F.count(F.when(active & F.col("accepting_new_clients"), 1)).alias("accepting"),
        F.count("embedding").alias("embedded"),
        F.count(F.when(active & no_tags, 1)).alias("untagged"),
        F.avg(F.col("profile_completeness").cast("double")).alias("mean_completeness"),
        (F.lit(1.0) * (F.unix_micros(as_of) - F.unix_micros(F.max("scraped_at"))) / 86400e6)
        .alias("age_days"))


def _row(name: str, category: str, severity, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"),
                    (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
                    passed.alias("passed"), detail.alias("detail"))


def _pct(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def single_pass_checks(profiles: DataFrame, as_of: Column, *, dim: int,
                       home_state: str = "CA") -> DataFrame:
    """Check rows of every check that one pass over the profiles answers."""
    one = single_pass(profiles, as_of, dim=dim, home_state=home_state)
    rows = [_row(name, category, severity, F.col(name) == 0,
                 F.concat(F.col(name).cast("string"), F.lit(" violation(s)")))
            for name, (category, severity, _) in violations(as_of, dim, home_state).items()]
    embedded = _pct(F.col("embedded"), F.col("total"))
    untagged = _pct(F.col("untagged"), F.col("active"))
    mean, age = F.col("mean_completeness"), F.col("age_days")
    rows += [
        _row("embedding_presence", RULES, "FAIL", F.coalesce(embedded >= 95.0, F.lit(True)),
             F.when(F.col("total") == 0, "no records (skipped)")
             .otherwise(F.format_string("%.1f%% embedded (%d/%d)", embedded, "embedded", "total"))),
        _row("active_have_modalities", RULES, "WARN", F.coalesce(untagged < 10.0, F.lit(True)),
             F.when(F.col("active") == 0, "no active records (skipped)")
             .otherwise(F.format_string("%.1f%% without modalities (%d/%d)", untagged, "untagged", "active"))),
        _row("totals_summary", SANITY, "INFO", F.lit(True),
             F.format_string("total=%d, active=%d, accepting=%d, embedded=%d",
                             "total", "active", "accepting", "embedded")),
        _row("data_recency", SANITY, "WARN", F.coalesce(age <= 7.0, F.lit(True)),
             F.when(age.isNull(), "no records (skipped)")
             .otherwise(F.format_string("newest record is %.1f day(s) old", age))),
        _row("avg_profile_completeness", SANITY, "WARN", F.coalesce(mean >= 0.6, F.lit(True)),
             F.when(mean.isNull(), "no records (skipped)")
             .otherwise(F.format_string("avg profile_completeness = %.3f", F.round(mean, 6)))),
    ]
    return one.select(F.inline(F.array(*rows)))


def duplicate_check(df: DataFrame, key: str, name: str = "unique_source_url") -> DataFrame:
    """How many key values occur more than once."""
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > 1)
    return repeated.agg(F.count("*").alias("n")).select(F.inline(F.array(_row(
        name, SCHEMA, "FAIL", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" duplicate(s)"))))))


def orphan_check(children: DataFrame, child_key: str, parents: DataFrame, parent_key: str,
                 name: str = "no_orphaned_feedback") -> DataFrame:
    """How many rows refer to no parent.

    References are counted per key before the anti-join, so a key many rows share is one row.
    """
    refs = children.groupBy(F.col(child_key).alias("_ref")).agg(F.count("*").alias("n"))
    # NULL refers to nothing and equals nothing, so the anti-join keeps it, as NOT EXISTS does.
    lost = refs.join(parents.select(F.col(parent_key).alias("_ref")).distinct(), "_ref", "left_anti")
    return lost.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.inline(F.array(_row(
        name, RULES, "FAIL", F.col("n") == 0, F.concat(F.col("n").cast("string"), F.lit(" orphan(s)"))))))


def _per_source(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("source").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"))


def _coverage() -> Column:
    return F.col("embedded") * 100.0 / F.col("n")


def source_distribution(profiles: DataFrame) -> DataFrame:
    """(source, n, share, embedded, coverage): rows and embedding coverage per source."""
    total = profiles.agg(F.count("*").alias("n")).scalar()
    return _per_source(profiles).select(
        "source", "n", (F.col("n") / total).alias("share"), "embedded", _coverage().alias("coverage"))


def source_checks(profiles: DataFrame) -> DataFrame:
    """No source above 80 % of the rows; at least 90 % embedded in each source."""
    per_source = _per_source(profiles)
    one = per_source.agg(F.coalesce(F.max("n") / F.sum("n"), F.lit(0.0)).alias("top"),
                         F.coalesce(F.min(_coverage()), F.lit(100.0)).alias("low"))
    dominant = F.col("top") > 0.80
    return one.select(F.inline(F.array(
        _row("source_distribution", SANITY, F.when(dominant, "WARN").otherwise("INFO"), ~dominant,
             F.format_string("largest source %.1f%%", F.col("top") * 100)),
        _row("embedding_coverage_by_source", SANITY, "WARN", F.col("low") >= 90.0,
             F.format_string("lowest coverage %.1f%%", F.col("low"))))))


def top_cities(profiles: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent cities (a report)."""
    return profiles.groupBy("city").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "city").limit(n)


def top_cities_check(profiles: DataFrame, n: int = 10) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "city"))),
                         lambda e: F.concat(F.coalesce(e["city"], F.lit("None")), F.lit("="),
                                            (-e["m"]).cast("string")))
    return top_cities(profiles, n).agg(listed.alias("l")).select(F.inline(F.array(_row(
        "top_cities", SANITY, "INFO", F.lit(True),
        F.when(F.size("l") == 0, "no data").otherwise(F.array_join("l", ", "))))))


def coverage(profiles: DataFrame, columns: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Rows and filled share (percent) of the named conditions, per group."""
    return profiles.groupBy(*by).agg(
        F.count("*").alias("total"), *[F.count(F.when(c, 1)).alias(f"has_{n}") for n, c in columns.items()]
    ).withColumns({f"{n}_pct": _pct(F.col(f"has_{n}"), F.col("total")) for n in columns})


def run_all(profiles: DataFrame, feedback: DataFrame, as_of: Column, *, dim: int = vocab.EMBEDDING_DIM,
            home_state: str = "CA") -> DataFrame:
    """All check rows: (name, category, severity, passed, detail)."""
    parts = [
        single_pass_checks(profiles, as_of, dim=dim, home_state=home_state),
        duplicate_check(profiles, "source_url"),
        orphan_check(feedback, "therapist_id", profiles, "id"),
        source_checks(profiles), top_cities_check(profiles),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report(checks: DataFrame) -> DataFrame:
    """Check counts by category and status (PASS or the severity of a failed check)."""
    status = F.when(F.col("passed"), "PASS").otherwise(F.col("severity"))
    return checks.groupBy("category", status.alias("status")).agg(F.count("*").alias("n"))


def verdict(checks: DataFrame) -> DataFrame:
    """One row: totals and whether any FAIL check failed."""
    def failed(severity: str) -> Column:
        return F.count(F.when(~F.col("passed") & (F.col("severity") == severity), 1))

    return checks.agg(F.count("*").alias("checks"), F.count(F.when(F.col("passed"), 1)).alias("passes"),
                      failed("WARN").alias("warns"), failed("FAIL").alias("fails")).withColumn(
        "status", F.when(F.col("fails") == 0, "PASSED").otherwise("FAILED"))
