"""Data-quality checks on the derived profiles and on the driver tables."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import PROFILES, profiles, table, with_
from matchweave import vocab
from matchweave.operators import quality as Q

AS_OF = "2024-01-05 00:00:00"
_DIM = 64


def as_of():
    return F.lit(AS_OF).cast("timestamp")


_INSURERS = "['" + "', '".join(vocab.INSURERS) + "']"
_MODALITIES = "['" + "', '".join(vocab.MODALITIES) + "']"

COUNTS = f"""
counts AS (
  SELECT count(CASE WHEN name IS NULL THEN 1 END) AS not_null_name, count(CASE WHEN state IS NULL THEN 1 END) AS not_null_state,
    count(CASE WHEN source_url IS NULL THEN 1 END) AS not_null_source_url, count(CASE WHEN source IS NULL THEN 1 END) AS not_null_source,
    count(CASE WHEN accepting_new_clients IS NULL THEN 1 END) AS not_null_accepting_new_clients,
    count(CASE WHEN is_active IS NULL THEN 1 END) AS not_null_is_active,
    count(CASE WHEN fee_min > fee_max THEN 1 END) AS fee_min_lte_fee_max, count(CASE WHEN rating < 0 OR rating > 5 THEN 1 END) AS rating_range,
    count(CASE WHEN len(list_filter(modalities, lambda x: NOT list_contains({_MODALITIES}, x))) > 0
      OR len(list_filter(insurance_providers, lambda x: NOT list_contains({_INSURERS}, x))) > 0 THEN 1 END) AS value_domains,
    count(CASE WHEN length(trim(bio)) < 20 THEN 1 END) AS bio_min_length,
    count(CASE WHEN profile_completeness < 0 OR profile_completeness > 1 THEN 1 END) AS profile_completeness_range,
    count(CASE WHEN fee_min < 0 OR fee_max < 0 THEN 1 END) AS no_negative_fees,
    count(CASE WHEN fee_min > 1000 OR fee_max > 1000 THEN 1 END) AS fees_not_excessive,
    count(CASE WHEN source_url NOT LIKE 'http%' THEN 1 END) AS source_url_format,
    count(CASE WHEN scraped_s > epoch(TIMESTAMP '{AS_OF}') + 60 THEN 1 END) AS no_future_timestamps,
    count(CASE WHEN state <> 'CA' THEN 1 END) AS all_home_state,
    count(CASE WHEN embedding IS NOT NULL AND len(embedding) <> {_DIM} THEN 1 END) AS embedding_dimensions,
    count(CASE WHEN embedding IS NOT NULL AND sqrt(list_inner_product(embedding, embedding)) < 0.01 THEN 1 END) AS no_zero_embeddings,
    0::BIGINT AS coordinates_in_bounds, count(*) AS total, count(CASE WHEN is_active THEN 1 END) AS active,
    count(CASE WHEN is_active AND accepting_new_clients THEN 1 END) AS accepting, count(embedding) AS embedded,
    count(CASE WHEN is_active AND len(modalities) = 0 THEN 1 END) AS untagged, avg(profile_completeness) AS mean_completeness,
    (epoch(TIMESTAMP '{AS_OF}') - max(scraped_s)) / 86400 AS age_days
  FROM profiles)
"""


@query("quality_single_pass", with_(PROFILES, COUNTS)
       + "SELECT * REPLACE (round(mean_completeness, 6) AS mean_completeness, round(age_days, 4) AS age_days) FROM counts")
def quality_single_pass(spark, folder):
    one = Q.single_pass(profiles(spark, folder), as_of(), dim=_DIM)
    return one.withColumns({"mean_completeness": F.round("mean_completeness", 6), "age_days": F.round("age_days", 4)})


_NAMES = [("not_null_name", "s", "FAIL"), ("not_null_state", "s", "FAIL"), ("not_null_source_url", "s", "FAIL"),
          ("not_null_source", "s", "FAIL"), ("not_null_accepting_new_clients", "s", "FAIL"),
          ("not_null_is_active", "s", "FAIL"), ("fee_min_lte_fee_max", "s", "FAIL"), ("rating_range", "s", "FAIL"),
          ("value_domains", "s", "FAIL"), ("bio_min_length", "q", "FAIL"),
          ("profile_completeness_range", "q", "FAIL"), ("no_negative_fees", "q", "FAIL"),
          ("fees_not_excessive", "q", "WARN"), ("source_url_format", "q", "FAIL"), ("no_future_timestamps", "q", "WARN"),
          ("all_home_state", "r", "FAIL"), ("embedding_dimensions", "r", "FAIL"), ("no_zero_embeddings", "r", "FAIL"),
          ("coordinates_in_bounds", "r", "WARN")]
_CATEGORY = {"s": Q.SCHEMA, "q": Q.QUALITY, "r": Q.RULES}

CHECKS = COUNTS + ",\nfeedback_refs AS (SELECT count(*) AS n FROM lineitem WHERE l_partkey NOT IN (SELECT id FROM profiles)),\n" + (
    "sources AS (SELECT source, count(*) AS n, count(embedding) AS e FROM profiles GROUP BY source),\nchecks AS (\n"
    + "\nUNION ALL ".join(f"SELECT '{n}' AS name, '{_CATEGORY[c]}' AS category, '{s}' AS severity, {n} = 0 AS passed FROM counts"
                          for n, c, s in _NAMES)
    + f"""
UNION ALL SELECT 'embedding_presence', '{Q.RULES}', 'FAIL', embedded * 100.0 / total >= 95 FROM counts
UNION ALL SELECT 'active_have_modalities', '{Q.RULES}', 'WARN', untagged * 100.0 / active < 10 FROM counts
UNION ALL SELECT 'totals_summary', '{Q.SANITY}', 'INFO', TRUE
UNION ALL SELECT 'data_recency', '{Q.SANITY}', 'WARN', age_days <= 7 FROM counts
UNION ALL SELECT 'avg_profile_completeness', '{Q.SANITY}', 'WARN', mean_completeness >= 0.6 FROM counts
UNION ALL SELECT 'unique_source_url', '{Q.SCHEMA}', 'FAIL', count(*) = count(DISTINCT source_url) FROM profiles
UNION ALL SELECT 'no_orphaned_feedback', '{Q.RULES}', 'FAIL', n = 0 FROM feedback_refs
UNION ALL SELECT 'source_distribution', '{Q.SANITY}', CASE WHEN max(n) / sum(n) > 0.8 THEN 'WARN' ELSE 'INFO' END, NOT max(n) / sum(n) > 0.8 FROM sources
UNION ALL SELECT 'embedding_coverage_by_source', '{Q.SANITY}', 'WARN', min(e * 100.0 / n) >= 90 FROM sources
UNION ALL SELECT 'top_cities', '{Q.SANITY}', 'INFO', TRUE
)""")


def _checks(spark, folder):
    feedback = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("therapist_id"))
    return Q.run_all(profiles(spark, folder), feedback, as_of(), dim=_DIM)


@query("quality_checks", with_(PROFILES, CHECKS) + "SELECT name, category, severity, passed FROM checks")
def quality_checks(spark, folder):
    return _checks(spark, folder).drop("detail")


_DETAILS = "\nUNION ALL ".join(f"SELECT '{n}' AS name, {n} || ' violation(s)' AS detail FROM counts" for n, _, _ in _NAMES) + """
UNION ALL SELECT 'embedding_presence', printf('%.1f%% embedded (%d/%d)', embedded * 100.0 / total, embedded, total) FROM counts
UNION ALL SELECT 'active_have_modalities', printf('%.1f%% without modalities (%d/%d)', untagged * 100.0 / active, untagged, active) FROM counts
UNION ALL SELECT 'totals_summary', printf('total=%d, active=%d, accepting=%d, embedded=%d', total, active, accepting, embedded) FROM counts
UNION ALL SELECT 'data_recency', printf('newest record is %.1f day(s) old', age_days) FROM counts
UNION ALL SELECT 'avg_profile_completeness', printf('avg profile_completeness = %.3f', round(round(mean_completeness, 6), 3)) FROM counts
UNION ALL SELECT 'unique_source_url', (count(*) - count(DISTINCT source_url)) || ' duplicate(s)' FROM profiles
UNION ALL SELECT 'no_orphaned_feedback', n || ' orphan(s)' FROM feedback_refs
UNION ALL SELECT 'source_distribution', printf('largest source %.1f%%', max(n) / sum(n) * 100) FROM sources
UNION ALL SELECT 'embedding_coverage_by_source', printf('lowest coverage %.1f%%', min(e * 100.0 / n)) FROM sources
UNION ALL SELECT 'top_cities', string_agg(coalesce(city, 'None') || '=' || n, ', ' ORDER BY n DESC, city NULLS FIRST) FROM (
  SELECT city, count(*) AS n FROM profiles GROUP BY city ORDER BY n DESC, city NULLS FIRST LIMIT 10)"""


@query("quality_checks_with_details", with_(PROFILES, CHECKS, f"details AS ({_DETAILS})")
       + "SELECT name, category, severity, passed, detail FROM checks JOIN details USING (name)")
def quality_checks_with_details(spark, folder):
    return _checks(spark, folder)


@query("quality_report", with_(PROFILES, CHECKS) + """
SELECT category, CASE WHEN passed THEN 'PASS' ELSE severity END AS status, count(*) AS n FROM checks GROUP BY ALL
""")
def quality_report(spark, folder):
    return Q.report(_checks(spark, folder))


@query("quality_verdict", with_(PROFILES, CHECKS) + """
SELECT count(*) AS checks, count(CASE WHEN passed THEN 1 END) AS passes, count(CASE WHEN NOT passed AND severity = 'WARN' THEN 1 END) AS warns,
  count(CASE WHEN NOT passed AND severity = 'FAIL' THEN 1 END) AS fails,
  CASE WHEN count(CASE WHEN NOT passed AND severity = 'FAIL' THEN 1 END) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status FROM checks
""")
def quality_verdict(spark, folder):
    return Q.verdict(_checks(spark, folder))


@query("duplicate_keys", """
SELECT 'unique_line' AS name, count(*) = 0 AS passed, count(*) || ' duplicate(s)' AS detail FROM (
  SELECT l_orderkey * 100 + l_linenumber AS k FROM lineitem GROUP BY 1 HAVING count(*) > 1)
""")
def duplicate_keys(spark, folder):
    rows = table(spark, folder, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("k"))
    return Q.duplicate_check(rows, "k", "unique_line").select("name", "passed", "detail")


@query("orphaned_references", """
SELECT 'orders_without_profile' AS name, count(*) = 0 AS passed, count(*) || ' orphan(s)' AS detail
FROM orders WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = o_custkey)
""")
def orphaned_references(spark, folder):
    return Q.orphan_check(table(spark, folder, "orders"), "o_custkey", table(spark, folder, "documents"), "doc_id",
                          "orders_without_profile").select("name", "passed", "detail")


@query("source_distribution", with_(PROFILES) + """
SELECT source, n, round(n / sum(n) OVER (), 6) AS share, embedded, round(embedded * 100.0 / n, 4) AS coverage FROM (
  SELECT source, count(*) AS n, count(embedding) AS embedded FROM profiles GROUP BY source)
""")
def source_distribution(spark, folder):
    return Q.source_distribution(profiles(spark, folder)).withColumns(
        {"share": F.round("share", 6), "coverage": F.round("coverage", 4)})


@query("top_cities", with_(PROFILES) + "SELECT city, count(*) AS n FROM profiles GROUP BY city ORDER BY n DESC, city NULLS FIRST LIMIT 10")
def top_cities(spark, folder):
    return Q.top_cities(profiles(spark, folder))


@query("coverage_by_source", with_(PROFILES) + """
SELECT source, count(*) AS total, count(gender) AS has_gender, count(CASE WHEN len(ethnicity) > 0 THEN 1 END) AS has_ethnicity,
  round(count(gender) * 100.0 / count(*), 4) AS gender_pct, round(count(CASE WHEN len(ethnicity) > 0 THEN 1 END) * 100.0 / count(*), 4) AS ethnicity_pct
FROM profiles WHERE is_active GROUP BY source
""")
def coverage_by_source(spark, folder):
    live = profiles(spark, folder).where("is_active")
    out = Q.coverage(live, {"gender": F.col("gender").isNotNull(), "ethnicity": F.size("ethnicity") > 0}, ["source"])
    return out.withColumns({c: F.round(c, 4) for c in ("gender_pct", "ethnicity_pct")})
