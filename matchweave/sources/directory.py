"""Directory API pages (JSON) to profile rows, and the label taxonomy they refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import first_tag, strip
from matchweave.operators.clean import safe_int, structured_completeness

HIT_SCHEMA = (
    "post_id string, post_title string, permalink string, credentials string, "
    "online array<string>, in_person array<string>, new_clients int, "
    "cost struct<individual_min: string, individual_max: string>, "
    "tax_ids struct<orientation: array<int>, specialty: array<int>, language: array<int>, "
    "age: array<int>, therapist_modality: array<int>, client_gender: array<int>>, "
    "locations array<struct<city: string, state: string, zip: string, lat: double, "
    "lng: double, online: boolean, in_person: boolean>>"
)


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """Landed directory hits, one JSON object per line; incomplete hits are dropped."""
    return complete_hits(spark.read.schema(HIT_SCHEMA).json(path))


def complete_hits(hits: DataFrame) -> DataFrame:
    """Hits with an id, a title and a link."""
    name = strip(F.coalesce(F.col("post_title"), F.lit("")))
    return hits.where(
        F.col("post_id").isNotNull() & (name != "")
        & (F.coalesce(F.col("permalink"), F.lit("")) != ""))


def primary_location(locations: Column) -> Column:
    """The first in-person entry that names a state, else the first entry."""
    in_person = F.filter(
        locations, lambda x: F.coalesce(x["in_person"], F.lit(False))
        & (F.coalesce(x["state"], F.lit("")) != ""))
    return F.coalesce(F.get(in_person, F.lit(0)), F.get(locations, F.lit(0)))


def record_formats(online: Column, in_person: Column, locations: Column) -> Column:
    """Session formats from the top-level lists, or from the locations if both are empty."""
    def truthy(a: Column) -> Column:
        return F.coalesce(F.size(a) > 0, F.lit(False))

    def any_location(flag: str) -> Column:
        return F.coalesce(
            F.exists(locations, lambda x: F.coalesce(x[flag], F.lit(False))), F.lit(False))

    top_online, top_office = truthy(online), truthy(in_person)
    neither = ~top_online & ~top_office
    has_online = top_online | (neither & any_location("online"))
    has_office = top_office | (neither & any_location("in_person"))
    return (F.when(has_online & has_office, F.array(F.lit("both")))
            .when(has_online, F.array(F.lit("telehealth")))
            .otherwise(F.array(F.lit("in_person"))))


# ---------------------------------------------------------------- taxonomy
def parse_taxonomy(pages: DataFrame, html: str, variable: str) -> DataFrame:
    """(type, id, label) rows from the script object ``variable`` embedded in a page.

    The object is parsed as JSON when it is valid; a page whose object is not (unquoted
    numeric keys, trailing commas) is read with a pattern over its ``"type": {id: "label"}``
    blocks instead.
    """
    script = F.regexp_extract(
        html, rf"(?s)<script[^>]*>((?:(?!</script>).)*?\b{variable}\s*=(?:(?!</script>).)*)</script>", 1)
    found = pages.select(script.alias("_script")).where(F.col("_script") != "")
    body = F.regexp_extract("_script", rf"(?s){variable}\s*=\s*(\{{.*\}})", 1)
    found = found.withColumn("_json", F.try_parse_json(body))

    def section(key: str) -> Column:
        return F.try_variant_get("_json", f"$.{key}", "map<string,variant>")

    whole = F.try_variant_get("_json", "$", "map<string,variant>")
    strict = found.where(F.col("_json").isNotNull()).select(
        F.explode(F.coalesce(section("taxonomies"), section("tax"), section("facets"), whole))
        .alias("type", "_labels"))
    strict = strict.select(
        "type", F.explode(F.try_variant_get("_labels", "$", "map<string,variant>")).alias("id", "_entry"))
    # An entry is a label, or an object that holds one.
    strict = strict.select("type", "id", F.coalesce(
        F.try_variant_get("_entry", "$.label", "string"), F.try_variant_get("_entry", "$", "string")).alias("label"))

    block = r'"(\w+)"\s*:\s*\{([^}]+)\}'
    lenient = found.where(F.col("_json").isNull()).select(
        F.explode(F.regexp_extract_all("_script", F.lit(block), F.lit(0))).alias("_block"))
    lenient = lenient.select(
        F.regexp_extract("_block", block, 1).alias("type"),
        F.explode(F.regexp_extract_all("_block", F.lit(r'(\d+\s*:\s*"[^"]*")'), F.lit(1))).alias("_e"))
    lenient = lenient.select(
        "type", F.regexp_extract("_e", r"(\d+)", 1).alias("id"),
        F.regexp_extract("_e", r':\s*"([^"]*)"', 1).alias("label"))
    rows = strict.unionByName(lenient).where(F.col("id").rlike(r"^\d+$"))
    return rows.select("type", F.col("id").cast("int").alias("id"), "label").distinct()


def resolve_labels(records: DataFrame, key: str, ids: str, kind: str, taxonomy: DataFrame,
                   output: str) -> DataFrame:
    """Add ``output``: the labels of an id array, in id order; unknown ids are skipped.

    A record's id list is short (it is one row's array), so the regrouping is per record.
    """
    labels = taxonomy.where(F.col("type") == kind).select(F.col("id").alias("_id"), "label")
    pairs = records.select(key, F.posexplode(ids).alias("_pos", "_id")).join(labels, "_id")
    lists = pairs.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "label"))),
                    lambda x: x["label"]).alias(output))
    return (records.join(lists, key, "left")
            .withColumn(output, F.coalesce(output, F.array().cast("array<string>"))))


def label_tags(labels: Column, keywords) -> Column:
    """Each label to the tag of its first keyword; unmatched labels dropped, tags once."""
    return F.array_distinct(
        F.array_compact(F.transform(labels, lambda x: first_tag(F.lower(x), keywords))))


def population_labels(session_type_ids: Column, ages: Column, genders: Column) -> Column:
    """Session types, then age labels, then gender labels, each label once."""
    names = F.create_map(*[F.lit(x) for kv in vocab.SESSION_TYPE_LABELS.items() for x in kv])
    types = F.transform(session_type_ids, lambda i: F.try_element_at(names, i))
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(c, empty) for c in (types, ages, genders)]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: F.coalesce(x, F.lit("")) != ""))


def hits_to_profiles(hits: DataFrame, taxonomy: DataFrame, source: str) -> DataFrame:
    """Directory hits to profile rows (gender, ethnicity and bio come from page enrichment)."""
    rows = complete_hits(hits)
    for kind, output in (("orientation", "_orientation"), ("specialty", "_specialty"),
                         ("language", "languages"), ("age", "_age"), ("client_gender", "_gender")):
        rows = resolve_labels(rows, "post_id", f"tax_ids.{kind}", kind, taxonomy, output)
    creds = F.filter(
        F.transform(F.split(F.coalesce("credentials", F.lit("")), ","), strip), lambda c: c != "")
    rows = (rows.withColumn("_loc", primary_location(F.col("locations")))
            .withColumn("_creds", creds)
            .withColumn("modalities", label_tags(F.col("_orientation"), vocab.ORIENTATION_LABELS))
            .withColumn("specializations", label_tags(F.col("_specialty"), vocab.SPECIALTY_LABELS))
            .withColumn("fee_min", safe_int(F.col("cost.individual_min"), 50))
            .withColumn("fee_max", safe_int(F.col("cost.individual_max"), 80)))
    return rows.select(
        F.lit(source).alias("source"), F.col("permalink").alias("source_url"),
        F.col("post_id").alias("source_id"), strip(F.col("post_title")).alias("name"),
        F.col("_creds").alias("credentials"), "modalities", "specializations",
        population_labels(F.col("tax_ids.therapist_modality"), F.col("_age"), F.col("_gender"))
        .alias("populations_served"),
        "languages", F.nullif(strip(F.col("_loc.city")), F.lit("")).alias("city"),
        F.lit("CA").alias("state"), F.nullif(F.col("_loc.zip"), F.lit("")).alias("zip_code"),
        F.col("_loc.lat").alias("latitude"), F.col("_loc.lng").alias("longitude"),
        record_formats(F.col("online"), F.col("in_person"), F.col("locations")).alias("session_formats"),
        F.array(F.lit("self_pay")).alias("insurance_providers"), F.lit(False).alias("sliding_scale"),
        "fee_min", "fee_max",
        (F.coalesce("new_clients", F.lit(1)) != 0).alias("accepting_new_clients"),
        F.lit("").alias("bio"),
        structured_completeness(
            F.col("modalities"), F.col("specializations"), F.col("_creds"), F.col("languages"),
            F.col("fee_min")).alias("profile_completeness"),
    )
