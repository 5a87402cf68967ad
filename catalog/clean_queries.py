"""Scans, cleaning, derived texts and scores."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import ASKED, PROFILES, profiles, searches_asked, strings, table, with_
from matchweave import vocab
from matchweave.functions import text as X
from matchweave.operators import clean as C
from matchweave.plans.ingestion import cap_per_group, union_sources
from matchweave.sources.tables import by_key, newest


@query("profile_scan", with_(PROFILES) + """
SELECT id, source, source_url, name, array_to_string(credentials, '|') AS credentials, gender, city, state, zip_code,
  sliding_scale, fee_min, fee_max, accepting_new_clients, rating, review_count, is_active FROM profiles
""")
def profile_scan(spark, folder):
    return profiles(spark, folder).select(
        "id", "source", "source_url", "name", F.array_join("credentials", "|").alias("credentials"), "gender", "city",
        "state", "zip_code", "sliding_scale", "fee_min", "fee_max", "accepting_new_clients", "rating", "review_count",
        "is_active")


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey = 1234")
def point_lookup(spark, folder):
    return by_key(table(spark, folder, "orders"), "o_orderkey", 1234).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")


@query("newest_runs", """
SELECT run, round(value, 4) AS value FROM (
  SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS run, avg(value) AS value FROM events GROUP BY 1) ORDER BY run DESC LIMIT 20
""")
def newest_runs(spark, folder):
    runs = table(spark, folder, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("run")).agg(
        F.round(F.avg("value"), 4).alias("value"))
    return newest(runs, "run")


# ---------------------------------------------------------------- cleaning
@query("validity_filter", """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN length(trim(coalesce(p_name, ''))) < 2 THEN 'name' WHEN p_brand IS NULL OR p_brand <> 'Brand#7' THEN 'state'
    WHEN coalesce(p_type, '') = '' THEN 'url' END AS reason FROM part) GROUP BY reason
""")
def validity_filter(spark, folder):
    reason = C.reject_reason(F.col("p_name"), F.col("p_brand"), F.col("p_type"), "Brand#7")
    return table(spark, folder, "part").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("clean_names", """
SELECT p_partkey, list_aggregate(list_transform(regexp_extract_all(n, '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') AS shouted,
  m AS quiet
FROM (SELECT p_partkey, upper(trim(p_name)) || ' O''' || upper(p_type) || '-' || upper(p_type) AS n, trim(p_name) || ' ' || p_brand AS m FROM part)
""")
def clean_names(spark, folder):
    shouted = F.concat(F.lit("  "), F.upper(F.replace("p_name", F.lit(" "), F.lit(" \t "))), F.lit("  O'"),
                       F.upper("p_type"), F.lit("-"), F.upper("p_type"), F.lit(" "))
    quiet = F.concat("p_name", F.lit("  \n"), "p_brand")
    return table(spark, folder, "part").select(
        "p_partkey", C.clean_name(shouted).alias("shouted"), C.clean_name(quiet).alias("quiet"))


_CLEAN = r"trim(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query("clean_bios", f"""
SELECT page_id, length(t) AS full_length, CASE WHEN length(t) < 20 THEN '' ELSE t[:5000] END AS bio
FROM (SELECT page_id, regexp_replace({_CLEAN.format('html')}, '[\\p{{C}}\\p{{Zl}}\\p{{Zp}}]|[^\\P{{Zs}} ]', '', 'g') AS t FROM pages)
""")
def clean_bios(spark, folder):
    html = F.col("html")
    return table(spark, folder, "pages").select(
        "page_id", F.length(C.clean_text(html)).cast("bigint").alias("full_length"), C.clean_bio(html).alias("bio"))


@query("fee_sanity", """
SELECT p_partkey, CASE WHEN lo < 0 OR lo > 1000 THEN NULL ELSE lo END AS fee_min,
  CASE WHEN lo < 0 OR lo > 1000 THEN NULL WHEN hi > 1000 THEN lo ELSE hi END AS fee_max
FROM (SELECT p_partkey, CASE WHEN p_size < 3 THEN NULL ELSE CAST(p_size * 25 - 100 AS INTEGER) END AS lo,
  CASE WHEN p_size > 48 THEN NULL ELSE CAST(p_size * 30 AS INTEGER) END AS hi FROM part)
""")
def fee_sanity(spark, folder):
    size = F.col("p_size")
    lo, hi = C.clean_fees(F.when(size >= 3, (size * 25 - 100).cast("int")), F.when(size <= 48, (size * 30).cast("int")))
    return table(spark, folder, "part").select("p_partkey", lo.alias("fee_min"), hi.alias("fee_max"))


@query("clean_cities", """
SELECT c_custkey, CASE WHEN c_nationkey > 20 THEN NULL ELSE 'Nation_' || c_nationkey END AS city
FROM customer
""")
def clean_cities(spark, folder):
    nation = F.col("c_nationkey")
    dirty = F.when(nation > 20, "\u200b\x01 ,,").otherwise(
        F.concat(F.lit(" \u200bnAtIoN_"), nation.cast("string"), F.lit(" ,,")))
    return table(spark, folder, "customer").select("c_custkey", C.clean_city(dirty).alias("city"))


@query("normalise_arrays", with_(PROFILES) + """
SELECT id, array_to_string(list_transform(languages, lambda x: trim(lower(x))), ',') AS languages,
  array_to_string(list_filter(list_transform(credentials, lambda x: upper(trim(x))), lambda x: x <> ''), ',') AS credentials
FROM profiles
""")
def normalise_arrays(spark, folder):
    noisy = F.transform("languages", lambda x: F.concat(F.lit(" "), F.upper(x), F.lit("\t")))
    return profiles(spark, folder).select(
        "id", F.array_join(C.clean_languages(noisy), ",").alias("languages"),
        F.array_join(C.clean_credentials(F.col("credentials")), ",").alias("credentials"))


@query("embedding_texts", with_(PROFILES) + """
SELECT id, md5('Therapist: ' || name || ' | Specializations: ' || array_to_string(specializations, ', ') || ' | Modalities: '
  || array_to_string(modalities, ', ') || ' | Bio: ' || bio || ' | Populations: ' || array_to_string(populations_served, ', ')
  || ' | Location: ' || coalesce(city || ', ', '') || state) AS digest FROM profiles
""")
def embedding_texts(spark, folder):
    return profiles(spark, folder).select("id", F.md5(C.embedding_text()).alias("digest"))


@query("keyword_documents", with_(PROFILES) + """
SELECT id, md5(name || ' ' || bio || ' ' || array_to_string(specializations, ' ') || ' ' || array_to_string(modalities, ' ') || ' '
  || array_to_string(populations_served, ' ') || ' ' || array_to_string(credentials, ' ')) AS digest FROM profiles
""")
def keyword_documents(spark, folder):
    return profiles(spark, folder).select("id", F.md5(C.search_document()).alias("digest"))


@query("fee_labels_and_excerpts", with_(PROFILES) + """
SELECT id, CASE WHEN coalesce(fee_min, 0) <> 0 AND coalesce(fee_max, 0) <> 0 THEN '$' || fee_min || '-$' || fee_max
  WHEN coalesce(fee_min, 0) <> 0 THEN 'from $' || fee_min WHEN sliding_scale THEN 'Sliding scale available' END AS fee_range,
  CASE WHEN length(bio) > 300 THEN bio[:300] || '...' ELSE bio END AS bio_excerpt
FROM (SELECT id, fee_min, CASE WHEN gender = 'Man' THEN NULL ELSE fee_max END AS fee_max, sliding_scale, bio FROM profiles)
""")
def fee_labels_and_excerpts(spark, folder):
    fee_max = F.when(~F.coalesce(F.col("gender") == "Man", F.lit(False)), F.col("fee_max"))
    return profiles(spark, folder).select(
        "id", C.fee_label(F.col("fee_min"), fee_max, F.col("sliding_scale")).alias("fee_range"),
        C.bio_excerpt(F.col("bio")).alias("bio_excerpt"))


@query("read_coercion", with_(PROFILES) + f"""
SELECT id, array_to_string(list_filter(specializations, lambda x: list_contains({vocab.SPECIALIZATIONS}, x)), ',') AS specializations,
  len(list_filter(coalesce(m, []), lambda x: list_contains({vocab.MODALITIES}, x))) AS n_modalities,
  CASE WHEN rating = 2.5 THEN NULL ELSE rating END AS rating, coalesce(b, '') AS bio, coalesce(n, 0) AS review_count
FROM (SELECT *, CASE WHEN gender = 'Man' THEN NULL ELSE modalities END AS m, CASE WHEN gender = 'Man' THEN NULL ELSE city END AS b,
  CASE WHEN gender = 'Woman' THEN NULL ELSE review_count END AS n FROM profiles)
""")
def read_coercion(spark, folder):
    man = F.coalesce(F.col("gender") == "Man", F.lit(False))
    raw = profiles(spark, folder).withColumns({
        "modalities": F.when(~man, F.col("modalities")), "bio": F.when(~man, F.col("city")),
        "review_count": F.when(F.coalesce(F.col("gender") != "Woman", F.lit(True)), F.col("review_count")),
        "rating": F.when(F.col("rating") == 2.5, 0.0).otherwise(F.col("rating"))})
    return C.coerce_profiles(raw).select(
        "id", F.array_join("specializations", ",").alias("specializations"),
        F.size("modalities").cast("bigint").alias("n_modalities"), "rating", "bio", "review_count")


@query("completeness_scores", with_(PROFILES) + """
SELECT id, round(0.3 * (len(modalities) > 0)::INT + 0.3 * (len(specializations) > 0)::INT + 0.2 * (len(credentials) > 2)::INT
    + 0.1 * (len(languages) > 0)::INT + 0.1 * (fee_min IS NOT NULL)::INT, 2)::DOUBLE AS structured,
  round(least(1.0, round(0.3 * (len(modalities) > 0)::INT + 0.3 * (len(specializations) > 0)::INT + 0.2 * (len(credentials) > 2)::INT
    + 0.1 * (len(languages) > 0)::INT + 0.1 * (fee_min IS NOT NULL)::INT, 2) + CASE WHEN coalesce(city, '') <> '' THEN 0.15 ELSE 0 END), 4)::DOUBLE AS with_bonus,
  round(0.35 * (length(bio) > 50)::INT + 0.25 * (len(modalities) > 0)::INT + 0.25 * (len(specializations) > 0)::INT
    + 0.15 * (len(insurance_providers) > 0)::INT, 2)::DOUBLE AS from_page
FROM profiles
""")
def completeness_scores(spark, folder):
    creds = F.when(F.size("credentials") > 2, F.col("credentials")).otherwise(strings())
    structured = C.structured_completeness(
        F.col("modalities"), F.col("specializations"), creds, F.col("languages"), F.col("fee_min"))
    return profiles(spark, folder).select(
        "id", structured.alias("structured"), F.round(C.with_bio_bonus(structured, F.col("city")), 4).alias("with_bonus"),
        C.page_completeness(F.col("bio"), F.col("modalities"), F.col("specializations"), F.col("insurance_providers"))
        .alias("from_page"))


@query("safe_integers", """
SELECT event_id, coalesce(TRY_CAST(trim(CASE event_type WHEN 'click' THEN ' ' || (json_extract_string(props, '$.k')) WHEN 'view' THEN event_type
  WHEN 'error' THEN '' ELSE json_extract_string(props, '$.k') END) AS INTEGER), 50) AS value FROM events
""")
def safe_integers(spark, folder):
    k = F.get_json_object("props", "$.k")
    loose = (F.when(F.col("event_type") == "click", F.concat(F.lit(" \t"), k)).when(F.col("event_type") == "view", F.col("event_type"))
             .when(F.col("event_type") == "error", "").otherwise(k))
    return table(spark, folder, "events").select("event_id", C.safe_int(loose, 50).alias("value"))


# ---------------------------------------------------------------- requests
@query("merged_filters", with_(ASKED) + """
SELECT query_id, coalesce(city, 'NATION_1') AS city, coalesce(insurance, 'optum') AS insurance, coalesce(max_budget, 99) AS max_budget,
  preferred_gender FROM asked
""")
def merged_filters(spark, folder):
    fields = ["city", "insurance", "max_budget", "preferred_gender"]
    rows = searches_asked(spark, folder).select(
        "query_id", F.struct(*fields).alias("explicit"),
        F.struct(F.lit("NATION_1").alias("city"), F.lit("optum").alias("insurance"), F.lit(99).alias("max_budget"),
                 F.lit(None).cast("string").alias("preferred_gender")).alias("inferred"))
    return C.merge_filters(rows, fields=fields)


@query("requests_with_content", with_(ASKED) + """
SELECT query_id FROM (SELECT *, CASE WHEN insurance IS NOT NULL THEN '' ELSE free_text END AS t FROM asked)
WHERE length(t) > 0 OR coalesce(city, zip_code, insurance, session_format, CAST(max_budget AS VARCHAR), preferred_gender,
  preferred_language, preferred_ethnicity, age_group) IS NOT NULL
""")
def requests_with_content(spark, folder):
    rows = searches_asked(spark, folder).withColumn(
        "free_text", F.when(F.col("insurance").isNotNull(), "").otherwise(F.col("free_text")))
    return rows.where(C.has_content()).select("query_id")


# ---------------------------------------------------------------- text functions
@query("text_functions", r"""
SELECT conv_id, turn, trim(regexp_replace(lower(role || ' #' || turn || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
  len(list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '')) AS n_tokens,
  sha256(lower(trim(text)) || '|{}')[:16] AS request_key,
  printf('%.1f%%', turn * 100.0 / 7) AS percent
FROM conversations
""")
def text_functions(spark, folder):
    label = F.concat("role", F.lit(" #"), F.col("turn").cast("string"), F.lit("!"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", X.slugify(label).alias("slug"), F.size(X.tokens(F.col("text"))).cast("bigint").alias("n_tokens"),
        X.request_key(F.concat(F.lit(" "), F.col("text")), F.lit("{}")).alias("request_key"),
        X.percent(F.col("turn") / 7).alias("percent"))


# ---------------------------------------------------------------- sources together
@query("union_of_sources", """
SELECT source, count(*) AS n, count(city) AS with_city, count(balance) AS with_balance FROM (
  SELECT 'customer' AS source, c_mktsegment AS city, c_acctbal AS balance FROM customer
  UNION ALL SELECT 'part', NULL, NULL FROM part UNION ALL SELECT 'supplier', NULL, s_acctbal FROM supplier) GROUP BY source
""")
def union_of_sources(spark, folder):
    a = table(spark, folder, "customer").select(
        F.lit("customer").alias("source"), F.col("c_mktsegment").alias("city"), F.col("c_acctbal").alias("balance"))
    b = table(spark, folder, "part").select(F.lit("part").alias("source"))
    c = table(spark, folder, "supplier").select(F.lit("supplier").alias("source"), F.col("s_acctbal").alias("balance"))
    return union_sources(a, b, c).groupBy("source").agg(
        F.count("*").alias("n"), F.count("city").alias("with_city"), F.count("balance").alias("with_balance"))


@query("cap_per_city", """
SELECT c_custkey, c_nationkey FROM (
  SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 20
ORDER BY c_nationkey, c_custkey LIMIT 300
""")
def cap_per_city(spark, folder):
    return cap_per_group(table(spark, folder, "customer"), "c_nationkey", "c_custkey", 20, 300).select(
        "c_custkey", "c_nationkey")
