"""Every search criterion as a predicate over logged (request, profile) pairs."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import ASKED, PROFILES, profiles, searches_asked, table, with_
from matchweave.operators import filters as P

# An order is a request that was shown the profile of its customer.
SHOWN_PAIRS = """
pairs AS (
  SELECT o.o_orderkey, p.*,
    CASE WHEN o_totalprice < 100000 THEN lower(p.city) WHEN o_totalprice < 200000 THEN 'nation_3' END AS q_city,
    CASE o_orderstatus WHEN 'F' THEN '3' WHEN 'O' THEN '7' END AS q_zip_code,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'aetna' WHEN '2-HIGH' THEN 'kaiser' WHEN '3-MEDIUM' THEN 'self_pay'
      WHEN '4-NOT SPECIFIED' THEN 'sliding_scale' END AS q_insurance,
    CASE o_orderstatus WHEN 'F' THEN 'telehealth' WHEN 'O' THEN 'both' ELSE 'in_person' END AS q_session_format,
    CASE WHEN o_totalprice < 150000 THEN 60 WHEN o_totalprice < 300000 THEN 120 WHEN o_totalprice < 350000 THEN 0 END AS q_max_budget,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'woman' WHEN '2-HIGH' THEN 'MAN' WHEN '5-LOW' THEN '' END AS q_preferred_gender,
    CASE o_orderstatus WHEN 'F' THEN 'French' WHEN 'O' THEN 'german' END AS q_preferred_language,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'WHITE' WHEN '3-MEDIUM' THEN 'asian or asian american' END AS q_preferred_ethnicity,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'child' WHEN '2-HIGH' THEN 'Adult' WHEN '3-MEDIUM' THEN 'adolescent'
      WHEN '4-NOT SPECIFIED' THEN 'senior' END AS q_age_group
  FROM orders o JOIN profiles p ON p.id = o.o_custkey
)"""


def shown_pairs(spark, folder):
    o = table(spark, folder, "orders")
    price, status, priority = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = o.join(profiles(spark, folder), F.col("o_custkey") == F.col("id"))
    return rows.withColumns({
        "q_city": F.when(price < 100000, F.lower("city")).when(price < 200000, "nation_3"),
        "q_zip_code": F.when(status == "F", "3").when(status == "O", "7"),
        "q_insurance": F.when(priority == "1-URGENT", "aetna").when(priority == "2-HIGH", "kaiser")
        .when(priority == "3-MEDIUM", "self_pay").when(priority == "4-NOT SPECIFIED", "sliding_scale"),
        "q_session_format": F.when(status == "F", "telehealth").when(status == "O", "both").otherwise("in_person"),
        "q_max_budget": F.when(price < 150000, 60).when(price < 300000, 120).when(price < 350000, 0),
        "q_preferred_gender": F.when(priority == "1-URGENT", "woman").when(priority == "2-HIGH", "MAN")
        .when(priority == "5-LOW", ""),
        "q_preferred_language": F.when(status == "F", "French").when(status == "O", "german"),
        "q_preferred_ethnicity": F.when(priority == "1-URGENT", "WHITE")
        .when(priority == "3-MEDIUM", "asian or asian american"),
        "q_age_group": F.when(priority == "1-URGENT", "child").when(priority == "2-HIGH", "Adult")
        .when(priority == "3-MEDIUM", "adolescent").when(priority == "4-NOT SPECIFIED", "senior"),
    })


def predicates() -> P.Predicates:
    return P.Predicates(lambda name: F.col(f"q_{name}"), F.col)


_ANY = "len(list_filter(populations_served, lambda x: {})) > 0"
AGE_SQL = f"""CASE lower(q_age_group)
  WHEN 'child' THEN {_ANY.format("x ILIKE '%child%' OR x ILIKE '%toddler%' OR x ILIKE '%preteen%' OR x ILIKE '%tween%'")}
  WHEN 'adolescent' THEN {_ANY.format("x ILIKE '%adolescent%' OR x ILIKE '%teen%' OR x ILIKE '%preteen%' OR x ILIKE '%tween%'")}
  WHEN 'adult' THEN {_ANY.format("x ILIKE '%adult%' OR x ILIKE '%elder%'")} ELSE TRUE END"""

# predicate -> (query-side columns it groups by, SQL condition)
CASES = {
    "state": ("state", "state = 'CA'"),
    "accepting": ("accepting_new_clients", "accepting_new_clients"),
    "embedded": ("source", "embedding IS NOT NULL"),
    "city": ("q_city", "q_city IS NULL OR lower(city) = lower(q_city)"),
    "zip": ("q_zip_code", "q_zip_code IS NULL OR zip_code = q_zip_code"),
    "insurance": ("q_insurance", "q_insurance IS NULL OR q_insurance = 'self_pay' OR sliding_scale "
                  "OR (q_insurance <> 'sliding_scale' AND list_contains(insurance_providers, q_insurance))"),
    "format": ("q_session_format", "q_session_format = 'both' OR list_contains(session_formats, q_session_format) "
               "OR list_contains(session_formats, 'both')"),
    "budget": ("q_max_budget", "coalesce(q_max_budget, 0) = 0 OR fee_min IS NULL OR fee_min <= q_max_budget OR sliding_scale"),
    "gender": ("q_preferred_gender", "coalesce(q_preferred_gender, '') = '' OR lower(gender) = lower(q_preferred_gender)"),
    "ethnicity": ("q_preferred_ethnicity", "q_preferred_ethnicity IS NULL OR "
                  "list_contains(list_transform(ethnicity, lambda x: lower(x)), lower(q_preferred_ethnicity))"),
    "language": ("q_preferred_language", "q_preferred_language IS NULL OR list_contains(languages, lower(q_preferred_language))"),
    "age_group": ("q_age_group", AGE_SQL),
}


def _register(name: str, group: str, condition: str) -> None:
    @query(f"filter_{name}", with_(PROFILES, SHOWN_PAIRS) + f"""
SELECT CAST({group} AS VARCHAR) AS criterion, count(*) AS pairs, count(CASE WHEN {condition} THEN 1 END) AS passed
FROM pairs GROUP BY ALL""")
    def run(spark, folder):
        passes = getattr(predicates(), name)()
        return shown_pairs(spark, folder).groupBy(F.col(group).cast("string").alias("criterion")).agg(
            F.count("*").alias("pairs"), F.count(F.when(passes, 1)).alias("passed"))


for _name, (_group, _condition) in CASES.items():
    _register(_name, _group, _condition)

_ALL_SQL = " AND ".join(f"({c})" for _, c in CASES.values())


@query("filter_all_criteria", with_(PROFILES, SHOWN_PAIRS) + f"SELECT o_orderkey, id FROM pairs WHERE {_ALL_SQL}")
def filter_all_criteria(spark, folder):
    return shown_pairs(spark, folder).where(predicates().all()).select("o_orderkey", "id")


@query("filter_need_level", with_(PROFILES, SHOWN_PAIRS) + f"""
SELECT o_orderkey, CAST(greatest(
  CASE WHEN {CASES['budget'][1]} THEN 0 ELSE 1 END, CASE WHEN {CASES['format'][1]} THEN 0 ELSE 2 END,
  CASE WHEN {CASES['insurance'][1]} THEN 0 ELSE 3 END, CASE WHEN {CASES['city'][1]} THEN 0 ELSE 4 END,
  CASE WHEN {CASES['zip'][1]} THEN 0 WHEN q_city IS NOT NULL THEN 4 ELSE 8 END,
  CASE WHEN {CASES['gender'][1]} THEN 0 ELSE 5 END, CASE WHEN {CASES['ethnicity'][1]} THEN 0 ELSE 6 END,
  CASE WHEN {CASES['language'][1]} THEN 0 ELSE 7 END) AS INTEGER) AS need
FROM pairs WHERE state = 'CA' AND accepting_new_clients AND embedding IS NOT NULL AND {AGE_SQL}
""")
def filter_need_level(spark, folder):
    need = predicates().need()
    return shown_pairs(spark, folder).select("o_orderkey", need.alias("need")).where(F.col("need").isNotNull())


@query("filter_explanations", with_(ASKED) + """
SELECT query_id, array_to_string(list_filter([
  CASE WHEN city IS NOT NULL THEN 'Location: ' || city || ', CA' END,
  CASE WHEN insurance IS NOT NULL THEN 'Insurance: ' || insurance END,
  CASE WHEN coalesce(max_budget, 0) <> 0 THEN 'Budget: up to $' || max_budget || '/session' END,
  CASE WHEN session_format IS NOT NULL THEN 'Format: ' || session_format END,
  CASE WHEN preferred_language IS NOT NULL THEN 'Language: ' || preferred_language END], lambda x: x IS NOT NULL), '; ') AS explanation
FROM asked
""")
def filter_explanations(spark, folder):
    return searches_asked(spark, folder).select(
        "query_id", F.array_join(P.explain_filters(), "; ").alias("explanation"))


@query("filtered_count", with_(PROFILES) + """
SELECT count(*) AS n FROM profiles WHERE state = 'CA' AND accepting_new_clients AND lower(city) = 'nation_3'
  AND (list_contains(insurance_providers, 'aetna') OR sliding_scale) AND (fee_min IS NULL OR fee_min <= 180 OR sliding_scale)
""")
def filtered_count(spark, folder):
    criteria = {"city": "NATION_3", "insurance": "aetna", "max_budget": 180}
    return P.count_filtered(profiles(spark, folder), criteria)


@query("catalogue_predicates", with_(PROFILES) + """
SELECT count(CASE WHEN is_active THEN 1 END) AS active, count(CASE WHEN is_active AND accepting_new_clients THEN 1 END) AS accepting,
  count(CASE WHEN city IS NOT NULL AND city <> '' THEN 1 END) AS with_city FROM profiles
""")
def catalogue_predicates(spark, folder):
    return profiles(spark, folder).agg(
        F.count(F.when(P.active(), 1)).alias("active"), F.count(F.when(P.active_accepting(), 1)).alias("accepting"),
        F.count(F.when(P.has_city(), 1)).alias("with_city"))
