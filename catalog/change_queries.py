"""Next snapshots of the profile table and the ingestion counts."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import PROFILES, profiles, strings, table, with_
from matchweave import vocab
from matchweave.operators import changes as C
from matchweave.operators.clean import clean_profiles
from matchweave.operators.embed import HashingEncoder, embed, embed_changed
from matchweave.plans.ingestion import write_ingested
from matchweave.sources.tables import shared_dir

NOW = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def _snapshot(spark, folder):
    """Profiles as the changed table: narrow columns, keyed by id."""
    return profiles(spark, folder).drop("embedding", "bio", "modalities")


@query("upsert_last_wins", """
WITH latest AS (
  SELECT o_custkey AS k, max_by(o_totalprice, o_orderkey) AS price, max_by(o_orderpriority, o_orderkey) AS priority
  FROM orders GROUP BY 1),
base AS (SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment <> 'BUILDING')
SELECT coalesce(c_custkey, k) AS c_custkey, CASE WHEN c_custkey IS NULL THEN priority ELSE c_name END AS c_name,
  CASE WHEN k IS NOT NULL THEN price ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey IS NULL THEN priority ELSE c_mktsegment END AS c_mktsegment
FROM base FULL OUTER JOIN latest ON c_custkey = k
""")
def upsert_last_wins(spark, folder):
    base = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'").select(
        "c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    changes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_name"),
        F.col("o_totalprice").alias("c_acctbal"), F.col("o_orderpriority").alias("c_mktsegment"),
        F.col("o_orderkey").alias("_seq"))
    return C.upsert(base, changes, key="c_custkey", refreshed=["c_acctbal"])


@query("upsert_profile_columns", with_(PROFILES) + """
SELECT coalesce(p.id, n.id) AS id, CASE WHEN n.url IS NOT NULL THEN n.name ELSE p.name END AS name, CASE WHEN p.id IS NULL THEN n.city ELSE p.city END AS city,
  CASE WHEN n.url IS NOT NULL THEN n.fee ELSE p.fee_min END AS fee_min, coalesce(p.source_url, n.url) AS source_url,
  CASE WHEN n.url IS NOT NULL THEN FALSE ELSE p.accepting_new_clients END AS accepting_new_clients
FROM (SELECT * FROM profiles) p FULL OUTER JOIN (
  SELECT s_suppkey + 900000 AS id, s_name AS name, 'x' AS city, CAST(s_acctbal AS INTEGER) AS fee, 'http://example.org/p/' || s_suppkey * 13 AS url FROM supplier) n
  ON n.url = p.source_url
""")
def upsert_profile_columns(spark, folder):
    base = profiles(spark, folder)
    sellers = table(spark, folder, "supplier")
    changed = sellers.select(
        (F.col("s_suppkey") + 900000).alias("id"), F.col("s_name").alias("name"), F.lit("x").alias("city"),
        F.rint("s_acctbal").cast("int").alias("fee_min"), F.lit(False).alias("accepting_new_clients"),
        F.concat(F.lit("http://example.org/p/"), (F.col("s_suppkey") * 13).cast("string")).alias("source_url"),
        F.lit(1).alias("_seq"))
    keep = ["id", "name", "city", "fee_min", "source_url", "accepting_new_clients", "last_updated"]
    return C.upsert(base.select(*keep), changed, refreshed=C.REFRESHED, now=now()).drop("last_updated")


@query("soft_delete_profiles", with_(PROFILES) + """
SELECT id, is_active AND NOT gone AS is_active, accepting_new_clients AND NOT gone AS accepting_new_clients, gone AS touched
FROM (SELECT *, id IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AS gone FROM profiles)
""")
def soft_delete_profiles(spark, folder):
    gone = table(spark, folder, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("id"))
    return C.soft_delete(_snapshot(spark, folder), gone, now=now()).select(
        "id", "is_active", "accepting_new_clients", (F.col("last_updated") == now()).alias("touched"))


_STATUS = ("CASE o_orderpriority WHEN '1-URGENT' THEN 404 WHEN '2-HIGH' THEN 503 WHEN '3-MEDIUM' THEN 403 "
           "WHEN '4-NOT SPECIFIED' THEN 200 WHEN '5-LOW' THEN 200 END")
_AUDIT = f"""
fetched AS (
  SELECT o_custkey AS id, max_by({_STATUS}, o_orderkey) AS status,
    max_by(CASE WHEN o_orderpriority = '5-LOW' THEN 'We are Currently NOT accepting new patients' ELSE 'Welcome' END, o_orderkey) AS text
  FROM orders GROUP BY 1),
judged AS (
  SELECT p.*, CASE WHEN status IS NULL OR status >= 500 THEN 'error' WHEN status = 404 THEN 'deleted'
    WHEN status = 200 AND lower(text) LIKE '%currently not accepting%' AND accepting_new_clients THEN 'deactivated'
    WHEN status = 200 AND lower(text) NOT LIKE '%currently not accepting%' AND NOT accepting_new_clients THEN 'activated' ELSE 'ok' END AS outcome
  FROM profiles p LEFT JOIN fetched f USING (id))
"""


def _audited(spark, folder):
    o = table(spark, folder, "orders")
    priority = F.col("o_orderpriority")
    status = (F.when(priority == "1-URGENT", 404).when(priority == "2-HIGH", 503).when(priority == "3-MEDIUM", 403)
              .when(priority.isin("4-NOT SPECIFIED", "5-LOW"), 200))
    text = F.when(priority == "5-LOW", "We are Currently NOT accepting new patients").otherwise("Welcome")
    pages = C.last_wins(o.select(F.col("o_custkey").alias("id"), status.alias("status"), text.alias("text"),
                                 "o_orderkey"), "id", "o_orderkey")
    return C.audit(_snapshot(spark, folder), pages, key="id", now=now())


@query("audit_snapshot", with_(PROFILES, _AUDIT) + """
SELECT id, is_active AND outcome <> 'deleted' AS is_active,
  CASE WHEN NOT is_active THEN accepting_new_clients WHEN outcome IN ('deleted', 'deactivated') THEN FALSE WHEN outcome = 'activated' THEN TRUE
    ELSE accepting_new_clients END AS accepting_new_clients FROM judged
""")
def audit_snapshot(spark, folder):
    return _audited(spark, folder)[0].select("id", "is_active", "accepting_new_clients")


@query("audit_outcomes", with_(PROFILES, _AUDIT) + "SELECT outcome, count(*) AS n FROM judged WHERE is_active GROUP BY outcome")
def audit_outcomes(spark, folder):
    return C.outcome_counts(_audited(spark, folder)[1])


# ---------------------------------------------------------------- enrichment
_FOUND = """
found AS (
  SELECT s_suppkey AS id, s_acctbal > 500 AS ok, CASE WHEN s_nationkey < 12 THEN 'Woman' END AS gender,
    CASE WHEN s_nationkey < 20 THEN ['White'] ELSE CAST([] AS VARCHAR[]) END AS ethnicity FROM supplier),
base AS (SELECT id, 'src' AS source, is_active, CASE WHEN gender = 'Man' THEN NULL ELSE gender END AS gender, ethnicity FROM profiles),
looked AS (
  SELECT b.id, b.is_active AND (b.gender IS NULL OR len(b.ethnicity) = 0) AS wanted, f.ok, b.gender AS old_gender, b.ethnicity AS old_ethnicity,
    coalesce(f.gender, b.gender) AS gender, CASE WHEN len(f.ethnicity) > 0 THEN f.ethnicity ELSE b.ethnicity END AS ethnicity
  FROM base b LEFT JOIN found f USING (id)),
outcomes AS (
  SELECT *, CASE WHEN NOT coalesce(ok, FALSE) THEN 'error'
    WHEN gender IS NOT DISTINCT FROM old_gender AND ethnicity = old_ethnicity THEN 'no_data'
    WHEN gender IS NOT NULL AND len(ethnicity) > 0 THEN 'updated' ELSE 'partial' END AS outcome FROM looked)
"""


def _filled(spark, folder):
    s = table(spark, folder, "supplier")
    found = s.select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 500).alias("ok"),
                     F.when(F.col("s_nationkey") < 12, "Woman").alias("gender"),
                     F.when(F.col("s_nationkey") < 20, strings("White")).otherwise(strings()).alias("ethnicity"))
    base = _snapshot(spark, folder).withColumns({
        "source": F.lit("src"), "gender": F.when(F.col("gender") != "Man", F.col("gender"))})
    return C.fill_missing(base, found, source="src", now=now())


@query("enrichment_fill_missing", with_(PROFILES, _FOUND) + """
SELECT id, CASE WHEN wanted AND outcome IN ('updated', 'partial') THEN gender ELSE old_gender END AS gender,
  array_to_string(CASE WHEN wanted AND outcome IN ('updated', 'partial') THEN ethnicity ELSE old_ethnicity END, ',') AS ethnicity FROM outcomes
""")
def enrichment_fill_missing(spark, folder):
    return _filled(spark, folder)[0].select("id", "gender", F.array_join("ethnicity", ",").alias("ethnicity"))


@query("enrichment_outcomes", with_(PROFILES, _FOUND) + "SELECT outcome, count(*) AS n FROM outcomes WHERE wanted GROUP BY outcome")
def enrichment_outcomes(spark, folder):
    return C.outcome_counts(_filled(spark, folder)[1])


@query("enrichment_overwrite_insurance", with_(PROFILES) + """
SELECT p.id, array_to_string(CASE WHEN p.is_active AND s.s_suppkey IS NOT NULL THEN
    CASE WHEN s_nationkey < 12 THEN ['optum'] ELSE CAST([] AS VARCHAR[]) END ELSE p.insurance_providers END, ',') AS insurance,
  CASE WHEN p.is_active AND s.s_suppkey IS NOT NULL THEN s_acctbal > 5000 ELSE p.sliding_scale END AS sliding_scale
FROM profiles p LEFT JOIN supplier s ON s.s_suppkey = p.id
""")
def enrichment_overwrite_insurance(spark, folder):
    found = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.when(F.col("s_nationkey") < 12, strings("optum")).otherwise(strings()).alias("insurance_providers"),
        (F.col("s_acctbal") > 5000).alias("sliding_scale"))
    after, _ = C.overwrite_insurance(
        _snapshot(spark, folder).withColumn("source", F.lit("src")), found, source="src", now=now())
    return after.select("id", F.array_join("insurance_providers", ",").alias("insurance"), "sliding_scale")


# ---------------------------------------------------------------- corrections
_FIXES = {"NATION_1": "Nation One", "NATION_2": "Nation Two", "NATION_3": None, "NATION_24": None}


@query("corrections_applied", with_(PROFILES) + """
SELECT id, CASE city WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_2' THEN 'Nation Two' WHEN 'NATION_3' THEN NULL WHEN 'NATION_24' THEN NULL ELSE city END AS city
FROM profiles
""")
def corrections_applied(spark, folder):
    return profiles(spark, folder).select("id", C.correct_value(F.col("city"), _FIXES).alias("city"))


@query("corrections_preview", with_(PROFILES) + """
SELECT city AS bad, CASE city WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_2' THEN 'Nation Two' END AS good, count(*) AS n
FROM profiles WHERE city IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_24') GROUP BY ALL
""")
def corrections_preview(spark, folder):
    return C.preview_corrections(profiles(spark, folder), "city", _FIXES)


@query("corrections_remaining", with_(PROFILES) + """
SELECT count(*) AS n FROM (SELECT CASE city WHEN 'NATION_1' THEN 'Nation One' WHEN 'NATION_2' THEN 'Nation Two' WHEN 'NATION_3' THEN NULL
  WHEN 'NATION_24' THEN NULL ELSE city END AS city FROM profiles) WHERE city IN ('NATION_1', 'NATION_2', 'NATION_3', 'NATION_24')
""")
def corrections_remaining(spark, folder):
    fixed = profiles(spark, folder).withColumn("city", C.correct_value(F.col("city"), _FIXES))
    return C.remaining_dirty(fixed, "city", _FIXES)


# ---------------------------------------------------------------- ingestion
_DIM = 32


@query("batch_embedding", f"""
WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM documents),
cells AS (SELECT doc_id, ('0x' || md5(w)[:4])::INT % {_DIM} AS cell, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL)
SELECT doc_id, cell, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS weight FROM cells
""")
def batch_embedding(spark, folder):
    vectors = embed(table(spark, folder, "documents"), "doc_id", "text", HashingEncoder(_DIM))
    cells = vectors.select("doc_id", F.posexplode("embedding").alias("cell", "weight")).where("weight > 0")
    return cells.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query("embedding_reuses_unchanged", """
SELECT count(*) AS rows, count(CASE WHEN lang = 'en' THEN 1 END) AS reused FROM documents
""")
def embedding_reuses_unchanged(spark, folder):
    docs = table(spark, folder, "documents")
    known = docs.where("lang = 'en'").select(
        "doc_id", F.sha2("text", 256).alias("text_hash"), F.array(F.lit(-1.0).cast("float")).alias("embedding"))
    return embed_changed(docs, known, "doc_id", "text", HashingEncoder(_DIM)).agg(
        F.count("*").alias("rows"), F.count(F.when(F.get("embedding", F.lit(0)) == -1.0, 1)).alias("reused"))


@query("ingestion_stage_counts", with_(PROFILES) + """
SELECT 'documents' AS source, count(*) AS scraped, count(CASE WHEN state = 'CA' THEN 1 END) AS cleaned,
  count(CASE WHEN state = 'CA' THEN 1 END) AS embedded, count(CASE WHEN state = 'CA' THEN 1 END) AS stored, 0::BIGINT AS failed FROM profiles
""")
def ingestion_stage_counts(spark, folder):
    return write_ingested(profiles(spark, folder), shared_dir(spark, "ingested"), "documents", text=F.col("bio"), encoder=HashingEncoder(_DIM))


@query("city_correction_table", """
SELECT fixed, count(*) AS n FROM (
  SELECT CASE WHEN c_nationkey < 5 THEN 'Los Angeles' WHEN c_nationkey < 10 THEN NULL WHEN c_nationkey < 15 THEN 'Murrieta' ELSE 'Fresno' END AS fixed
  FROM customer) GROUP BY fixed
""")
def city_correction_table(spark, folder):
    n = F.col("c_nationkey")
    city = (F.when(n < 5, "Los Angles").when(n < 10, "Sf Bay Area").when(n < 15, "Murrietta").otherwise("Fresno"))
    fixed = C.correct_value(city, vocab.CITY_CORRECTIONS)
    return table(spark, folder, "customer").groupBy(fixed.alias("fixed")).agg(F.count("*").alias("n"))
