"""Profiles, searches and logs derived from the driver tables, in Spark and in SQL.

The driver tables hold no profiles or logs, so they are derived: a document is a profile (its
text the bio, the customer of the same number its structured side, the vector of the same
number its embedding), a benchmark text is a search (the supplier of the same number its
criteria), an order is a logged search and its line items are feedback on it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.functions.text import all_tags


# Declared so that no job has to read a file footer for them.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}

def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A driver table; timestamps without zone are read as UTC instants."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")
    zoned = {f.name: F.col(f.name).cast("timestamp") for f in df.schema
             if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(zoned) if zoned else df


# Words of the invented texts that stand for modality keywords.
TAG_WORDS = [
    (" the ", "cognitive_behavioral_therapy"), (" und ", "dialectical_behavior_therapy"),
    (" les ", "emdr"), (" with ", "acceptance_commitment_therapy"), (" que ", "psychodynamic"),
    (" from ", "humanistic"), (" this ", "mindfulness_based"), (" er ", "somatic"),
    (" los ", "gottman_method"), (" by ", "exposure_therapy"), (" nd ", "trauma_informed"),
    (" ha ", "narrative_therapy"), ("hehely", "solution_focused"),
    ("ononst", "motivational_interviewing"), ("inoran", "family_systems"),
    (" th ", "integrative"), (" st ", "cbt_insomnia"), (" und die ", "dialectical_behavior_therapy"),
    (" as ", "emotionally_focused_therapy"),
]


def tags_sql(text: str, words=TAG_WORDS) -> str:
    """The same tagging in SQL: found tags in table order, each once."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    cases = ", ".join(
        f"CASE WHEN contains({text}, {quoted(w)}) THEN {quoted(t)} END" for w, t in words)
    found = f"list_filter([{cases}], lambda x: x IS NOT NULL)"
    return ordered_distinct_sql(found)


def ordered_distinct_sql(items: str) -> str:
    return (f"list_transform(list_filter(list_transform({items}, lambda x, i: "
            f"struct_pack(x := x, first := list_position({items}, x) = i)), "
            f"lambda e: e.first), lambda e: e.x)")


def strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    labels = table(spark, folder, "labels")
    people = table(spark, folder, "customer").withColumnRenamed("c_custkey", "doc_id")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, nation.n_regionkey == region.r_regionkey)
    rows = (docs.join(vectors, "doc_id", "left").join(labels, "doc_id", "left")
            .join(people, "doc_id", "left")
            .join(places, F.col("c_nationkey") == F.col("n_nationkey"), "left"))
    balance, segment, lang = F.col("c_acctbal"), F.col("c_mktsegment"), F.col("lang")
    fee = F.when(balance >= 0, F.floor(balance / 40).cast("int"))
    return rows.select(
        F.col("doc_id").alias("id"), "source",
        F.concat(F.lit("http://example.org/p/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.col("doc_id").cast("string").alias("source_id"),
        F.coalesce("c_name", F.lit("Unknown")).alias("name"),
        F.when(F.col("quality") == 1, strings(" lmft ", "PhD", "")).otherwise(strings(" ")).alias("credentials"),
        F.lit(None).cast("string").alias("license_number"), F.lit(None).cast("int").alias("years_experience"),
        F.when(F.col("c_nationkey") < 8, "Woman").when(F.col("c_nationkey") < 16, "Man")
        .when(F.col("c_nationkey") < 22, "Non-binary").alias("gender"),
        F.when(F.col("r_name") == "AFRICA", strings("Black or African American"))
        .when(F.col("r_name") == "ASIA", strings("Asian or Asian American"))
        .when(F.col("r_name") == "AMERICA", strings("White", "Hispanic or Latino"))
        .when(F.col("r_name") == "EUROPE", strings("White")).otherwise(strings()).alias("ethnicity"),
        all_tags(F.lower("text"), TAG_WORDS).alias("modalities"),
        F.when(segment == "HOUSEHOLD", strings("family", "anxiety"))
        .when(segment == "BUILDING", strings("career", "not_a_tag")).otherwise(strings()).alias("specializations"),
        F.when(segment == "MACHINERY", strings("Adults"))
        .when(segment == "BUILDING", strings("Children (6-10)", "Adults"))
        .when(segment == "AUTOMOBILE", strings("Adolescents / Teenagers (14 - 19)"))
        .when(segment == "HOUSEHOLD", strings("Elders (65+)")).otherwise(strings()).alias("populations_served"),
        F.when(lang == "en", strings("english")).when(lang == "fr", strings("english", "french"))
        .when(lang == "de", strings("german")).otherwise(strings("spanish", "english")).alias("languages"),
        F.col("n_name").alias("city"),
        F.when(F.col("n_regionkey") == 4, "NV").otherwise("CA").alias("state"),
        F.col("c_nationkey").cast("string").alias("zip_code"), F.lit(None).cast("string").alias("county"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.when(lang == "en", strings("both")).when(lang == "fr", strings("telehealth"))
        .otherwise(strings("in_person")).alias("session_formats"),
        F.when(segment == "MACHINERY", strings("aetna", "cigna")).when(segment == "BUILDING", strings("kaiser"))
        .when(segment == "AUTOMOBILE", strings("blue_cross", "optum"))
        .when(segment == "HOUSEHOLD", strings("aetna")).otherwise(strings()).alias("insurance_providers"),
        F.coalesce(balance < 500, F.lit(False)).alias("sliding_scale"),
        fee.alias("fee_min"), (fee + 50).alias("fee_max"),
        F.coalesce(balance < 9000, F.lit(False)).alias("accepting_new_clients"), F.col("text").alias("bio"),
        F.when(F.col("quality") == 1, F.when(F.col("toxic") == 0, 4.8).otherwise(3.5))
        .when(F.col("quality") == 0, F.when(F.col("toxic") == 0, 2.5).otherwise(1.5)).alias("rating"),
        F.floor(F.col("n_chars") / 50).cast("int").alias("review_count"),
        F.when(lang == "en", 0.9).when(lang == "fr", 0.8).otherwise(0.6).alias("profile_completeness"),
        "embedding",
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("scraped_at"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("last_updated"),
        (F.coalesce("toxic", F.lit(0)) == 0).alias("is_active"))


PROFILES = f"""
profiles AS (
  SELECT d.doc_id AS id, d.source, 'http://example.org/p/' || d.doc_id AS source_url,
    CAST(d.doc_id AS VARCHAR) AS source_id, coalesce(c.c_name, 'Unknown') AS name,
    CASE WHEN l.quality = 1 THEN [' lmft ', 'PhD', ''] ELSE [' '] END AS credentials,
    CASE WHEN c_nationkey < 8 THEN 'Woman' WHEN c_nationkey < 16 THEN 'Man'
         WHEN c_nationkey < 22 THEN 'Non-binary' END AS gender,
    CASE r_name WHEN 'AFRICA' THEN ['Black or African American'] WHEN 'ASIA' THEN ['Asian or Asian American']
         WHEN 'AMERICA' THEN ['White', 'Hispanic or Latino'] WHEN 'EUROPE' THEN ['White']
         ELSE CAST([] AS VARCHAR[]) END AS ethnicity,
    {tags_sql("lower(d.text)")} AS modalities,
    CASE c_mktsegment WHEN 'HOUSEHOLD' THEN ['family', 'anxiety'] WHEN 'BUILDING' THEN ['career', 'not_a_tag']
         ELSE CAST([] AS VARCHAR[]) END AS specializations,
    CASE c_mktsegment WHEN 'MACHINERY' THEN ['Adults'] WHEN 'BUILDING' THEN ['Children (6-10)', 'Adults']
         WHEN 'AUTOMOBILE' THEN ['Adolescents / Teenagers (14 - 19)'] WHEN 'HOUSEHOLD' THEN ['Elders (65+)']
         ELSE CAST([] AS VARCHAR[]) END AS populations_served,
    CASE d.lang WHEN 'en' THEN ['english'] WHEN 'fr' THEN ['english', 'french'] WHEN 'de' THEN ['german']
         ELSE ['spanish', 'english'] END AS languages,
    n_name AS city, CASE WHEN n_regionkey = 4 THEN 'NV' ELSE 'CA' END AS state,
    CAST(c_nationkey AS VARCHAR) AS zip_code,
    CASE d.lang WHEN 'en' THEN ['both'] WHEN 'fr' THEN ['telehealth'] ELSE ['in_person'] END AS session_formats,
    CASE c_mktsegment WHEN 'MACHINERY' THEN ['aetna', 'cigna'] WHEN 'BUILDING' THEN ['kaiser']
         WHEN 'AUTOMOBILE' THEN ['blue_cross', 'optum'] WHEN 'HOUSEHOLD' THEN ['aetna']
         ELSE CAST([] AS VARCHAR[]) END AS insurance_providers,
    coalesce(c_acctbal < 500, FALSE) AS sliding_scale,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 40) AS INTEGER) END AS fee_min,
    CASE WHEN c_acctbal >= 0 THEN CAST(floor(c_acctbal / 40) AS INTEGER) + 50 END AS fee_max,
    coalesce(c_acctbal < 9000, FALSE) AS accepting_new_clients, d.text AS bio,
    CASE WHEN l.quality = 1 THEN CASE WHEN l.toxic = 0 THEN 4.8::DOUBLE ELSE 3.5 END
         WHEN l.quality = 0 THEN CASE WHEN l.toxic = 0 THEN 2.5::DOUBLE ELSE 1.5 END END AS rating,
    CAST(floor(d.n_chars / 50) AS INTEGER) AS review_count,
    CASE d.lang WHEN 'en' THEN 0.9::DOUBLE WHEN 'fr' THEN 0.8 ELSE 0.6 END AS profile_completeness,
    e.embedding, 1704067200 + d.doc_id * 60 AS scraped_s, coalesce(l.toxic, 0) = 0 AS is_active
  FROM documents d
  LEFT JOIN embeddings e ON e.vec_id = d.doc_id
  LEFT JOIN labels l ON l.doc_id = d.doc_id
  LEFT JOIN customer c ON c.c_custkey = d.doc_id
  LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
  LEFT JOIN region r ON r.r_regionkey = n.n_regionkey
)"""


def searches_asked(spark: SparkSession, folder: str) -> DataFrame:
    """Search requests with criteria, in the query schema (keys are numbers here)."""
    texts = table(spark, folder, "benchmark")
    vectors = table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    sellers = table(spark, folder, "supplier").withColumnRenamed("s_suppkey", "item_id")
    nation = table(spark, folder, "nation")
    rows = (texts.join(vectors, "item_id", "left").join(sellers, "item_id", "left")
            .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left"))
    b, n = F.col("s_acctbal"), F.col("s_nationkey")
    return rows.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("free_text"),
        F.when(n < 5, strings("Panic attacks", "insomnia")).when(n < 10, strings("anxiety"))
        .when(n < 15, strings("severe social anxiety", "made_up_xyz"))
        .when(n < 20, strings("Self esteem", "grief")).when(n < 25, strings("stress_burnout", "anxiety", "ptsd"))
        .otherwise(strings()).alias("concerns"),
        "embedding",
        F.when(b < 4000, F.col("n_name")).alias("city"),
        F.when(b.between(2000, 3000) | (b > 9000), n.cast("string")).alias("zip_code"),
        F.when(b < 1500, "aetna").when(b < 2500, "kaiser").when(b < 3500, "self_pay")
        .when(b < 4500, "sliding_scale").when(b < 6000, "optum").alias("insurance"),
        F.when(b < 1000, "telehealth").when(b < 3000, "both").when(b < 6500, "in_person").alias("session_format"),
        F.when(b < 2000, 60).when(b < 5000, 150).alias("max_budget"),
        F.when(n < 6, "woman").when(n < 12, "MAN").alias("preferred_gender"),
        F.when(b > 7000, "French").when(b < 800, "german").alias("preferred_language"),
        F.when(n.between(10, 16), "white").alias("preferred_ethnicity"),
        F.when(b > 8500, "child").when(b.between(5500, 7000), "Adult").when(b < -500, "senior").alias("age_group"))


ASKED = """
asked AS (
  SELECT b.item_id AS query_id, b.text AS free_text,
    CASE WHEN s_nationkey < 5 THEN ['Panic attacks', 'insomnia'] WHEN s_nationkey < 10 THEN ['anxiety']
         WHEN s_nationkey < 15 THEN ['severe social anxiety', 'made_up_xyz']
         WHEN s_nationkey < 20 THEN ['Self esteem', 'grief']
         WHEN s_nationkey < 25 THEN ['stress_burnout', 'anxiety', 'ptsd']
         ELSE CAST([] AS VARCHAR[]) END AS concerns,
    e.embedding, CASE WHEN s_acctbal < 4000 THEN n_name END AS city,
    CASE WHEN s_acctbal BETWEEN 2000 AND 3000 OR s_acctbal > 9000 THEN CAST(s_nationkey AS VARCHAR) END AS zip_code,
    CASE WHEN s_acctbal < 1500 THEN 'aetna' WHEN s_acctbal < 2500 THEN 'kaiser' WHEN s_acctbal < 3500 THEN 'self_pay'
         WHEN s_acctbal < 4500 THEN 'sliding_scale' WHEN s_acctbal < 6000 THEN 'optum' END AS insurance,
    CASE WHEN s_acctbal < 1000 THEN 'telehealth' WHEN s_acctbal < 3000 THEN 'both'
         WHEN s_acctbal < 6500 THEN 'in_person' END AS session_format,
    CASE WHEN s_acctbal < 2000 THEN 60 WHEN s_acctbal < 5000 THEN 150 END AS max_budget,
    CASE WHEN s_nationkey < 6 THEN 'woman' WHEN s_nationkey < 12 THEN 'MAN' END AS preferred_gender,
    CASE WHEN s_acctbal > 7000 THEN 'French' WHEN s_acctbal < 800 THEN 'german' END AS preferred_language,
    CASE WHEN s_nationkey BETWEEN 10 AND 16 THEN 'white' END AS preferred_ethnicity,
    CASE WHEN s_acctbal > 8500 THEN 'child' WHEN s_acctbal BETWEEN 5500 AND 7000 THEN 'Adult'
         WHEN s_acctbal < -500 THEN 'senior' END AS age_group
  FROM benchmark b
  LEFT JOIN embeddings e ON e.vec_id = b.item_id
  LEFT JOIN supplier s ON s.s_suppkey = b.item_id
  LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey
)"""


# ---------------------------------------------------------------- logs
def search_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as logged searches: the customer is the session."""
    o = table(spark, folder, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("session_id"),
        F.concat("o_orderpriority", F.lit(" "), F.col("o_orderstatus")).alias("free_text"),
        F.floor(F.col("o_totalprice") / 50000).cast("int").alias("filtered_count"),
        (F.col("o_totalprice") / 100 - 100).alias("latency_ms"),
        (F.col("o_orderstatus") == "F").alias("cache_hit"), F.col("o_orderdate").alias("created_at"))


SEARCHES = """
searches AS (
  SELECT o_orderkey AS id, o_custkey AS session_id, o_orderpriority || ' ' || o_orderstatus AS free_text,
    CAST(floor(o_totalprice / 50000) AS INTEGER) AS filtered_count, o_totalprice / 100 - 100 AS latency_ms,
    o_orderstatus = 'F' AS cache_hit, o_orderdate AS created_at
  FROM orders
)"""


def feedback_log(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as feedback on the part shown at their line number."""
    li = table(spark, folder, "lineitem")
    view = F.col("l_returnflag") == "R"
    return li.select(
        F.col("l_orderkey").alias("query_id"), F.col("l_partkey").alias("item"),
        F.when(F.col("l_discount") > 0.065, 5).when(F.col("l_discount") > 0.035, 3)
        .when(F.col("l_discount") > 0.015, 2).otherwise(1).alias("rating"),
        F.col("l_linenumber").alias("rank_position"),
        F.when(view, "profile_view").otherwise("explicit").alias("event_type"),
        (F.col("l_linestatus") == "F").alias("booked"), F.col("l_shipdate").alias("created_at"))


FEEDBACK = """
feedback AS (
  SELECT l_orderkey AS query_id, l_partkey AS item,
    CASE WHEN l_discount > 0.065 THEN 5 WHEN l_discount > 0.035 THEN 3 WHEN l_discount > 0.015 THEN 2 ELSE 1 END AS rating,
    l_linenumber AS rank_position, CASE WHEN l_returnflag = 'R' THEN 'profile_view' ELSE 'explicit' END AS event_type,
    l_linestatus = 'F' AS booked, l_shipdate AS created_at
  FROM lineitem
)"""


def shown_log(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, position, item): one part per order and line number."""
    return (table(spark, folder, "lineitem")
            .groupBy(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("position"))
            .agg(F.min("l_partkey").alias("item")))


SHOWN = """
shown AS (
  SELECT l_orderkey AS query_id, l_linenumber AS position, min(l_partkey) AS item
  FROM lineitem GROUP BY 1, 2
)"""


def with_(*parts: str) -> str:
    """A WITH clause of the named parts."""
    return "WITH " + ",".join(parts) + "\n"
