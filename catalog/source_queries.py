"""Landed directory records, page fields and logs: files made from the driver tables, read back by the library's readers."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import FEEDBACK, SEARCHES, feedback_log, search_log, table, with_
from matchweave.operators import extract as H
from matchweave.sources import directory as D
from matchweave.sources import tables as T
from matchweave.sources.knowledge import read_knowledge


def _written(df, spark, name):
    """One text column as files of lines in the shared folder."""
    path = T.shared_dir(spark, name)
    df.write.text(path)
    return path


def _said(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


@query("directory_hits", """
SELECT c_custkey::VARCHAR AS post_id,
  CASE WHEN c_nationkey % 5 < 3 AND c_nationkey % 2 = 0 THEN 'A' || c_nationkey WHEN c_nationkey % 7 < 5 THEN 'B' || c_nationkey ELSE 'A' || c_nationkey END AS city,
  CASE WHEN online AND office THEN 'both' WHEN online THEN 'telehealth' ELSE 'in_person' END AS session_format
FROM (SELECT *,
    CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 4 = 0 THEN c_nationkey % 3 = 0 ELSE c_nationkey % 5 = 4 END AS online,
    CASE WHEN c_nationkey % 3 = 0 OR c_nationkey % 4 = 0 THEN c_nationkey % 4 = 0 ELSE c_nationkey % 5 < 3 OR c_nationkey % 7 < 5 END AS office FROM customer)
WHERE c_nationkey NOT IN (5, 6)
""")
def directory_hits(spark, folder):
    """Records without a title or a link are dropped; the first office that names a state is the place."""
    n, flag = F.col("c_nationkey"), lambda c: F.when(c, F.array(F.lit("yes"))).otherwise(F.array().cast("array<string>"))
    place = lambda city, state, online, office: F.struct(
        city.alias("city"), state.alias("state"), online.alias("online"), office.alias("in_person"))
    ca = F.lit("CA")
    hits = table(spark, folder, "customer").select(F.to_json(F.struct(
        F.col("c_custkey").cast("string").alias("post_id"), F.when(n == 5, "  ").otherwise(F.col("c_name")).alias("post_title"),
        F.when(n == 6, "").otherwise(_said("http://x/", F.col("c_custkey"))).alias("permalink"),
        flag(n % 3 == 0).alias("online"), flag(n % 4 == 0).alias("in_person"),
        F.array(place(_said("A", n), F.when(n % 2 == 0, ca).otherwise(""), n % 5 == 4, n % 5 < 3),
                place(_said("B", n), ca, F.lit(False), n % 7 < 5)).alias("locations"))).alias("value"))
    rows = D.read_hits(spark, _written(hits, spark, "hits"))
    return rows.select("post_id", D.primary_location(F.col("locations"))["city"].alias("city"),
                       D.record_formats(F.col("online"), F.col("in_person"), F.col("locations"))[0].alias("session_format"))


@query("directory_labels", """
SELECT c_custkey, array_to_string(list_filter([a.n_name, b.n_name], lambda x: x IS NOT NULL), '|') AS labels,
  array_to_string(list_filter(['couples', a.n_name, CASE WHEN b.n_name <> a.n_name THEN b.n_name END], lambda x: x IS NOT NULL), '|') AS populations
FROM customer LEFT JOIN nation a ON a.n_nationkey = c_nationkey LEFT JOIN nation b ON b.n_nationkey = c_nationkey + 3
""")
def directory_labels(spark, folder):
    """Ids of a record to labels of the taxonomy that a page's script holds; unknown ids are skipped."""
    nation, customer = table(spark, folder, "nation"), table(spark, folder, "customer")
    labels = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), "n_name"))))
    script = nation.agg(labels.alias("m")).select(
        _said("<html><script>var other = 1;</script><script>var cfg = {\"taxonomies\": {\"specialty\": ", F.to_json("m"), "}};</script></html>").alias("value"))
    taxonomy = D.parse_taxonomy(spark.read.text(_written(script, spark, "taxonomy"), wholetext=True), "value", "cfg")
    n = F.col("c_nationkey")
    rows = customer.select("c_custkey", F.array(n, F.lit(99), n + 3).cast("array<int>").alias("ids"))
    found = D.resolve_labels(rows, "c_custkey", "ids", "specialty", taxonomy, "labels")
    people = D.population_labels(F.array(F.lit(735), F.lit(1)), F.col("labels"), F.col("labels"))
    return found.select("c_custkey", F.array_join("labels", "|").alias("labels"), F.array_join(people, "|").alias("populations"))


@query("page_gender_and_ethnicity", """
SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN c_name END AS gender,
  CASE c_mktsegment WHEN 'MACHINERY' THEN 'White|Seg ' || c_nationkey WHEN 'BUILDING' THEN 'Asian or Asian American' ELSE 'Seg ' || c_nationkey END AS ethnicity
FROM customer
""")
def page_gender_and_ethnicity(spark, folder):
    """Labelled fields of a page; the last field of a label counts, and known labels take their usual form."""
    field = lambda label, value: _said("<p class='x'>\n<span>", label, "</span><br />", value, "</p>")
    seg, other = F.col("c_mktsegment"), _said("Seg ", F.col("c_nationkey"))
    group = F.when(seg == "MACHINERY", _said("white, ", other)).when(seg == "BUILDING", "ASIAN or asian American").otherwise(other)
    html = F.concat(F.lit("<html><body>"), F.when(F.col("c_nationkey") % 2 == 0, F.concat(field("Gender", F.lit("old")), field("Gender", _said("<b>", F.col("c_name"), "</b>")))).otherwise(""),
                    field("Race/Ethnicity", group), F.lit("</body></html>"))
    found = H.gender_and_ethnicity(html)
    return table(spark, folder, "customer").select("c_custkey", found["gender"].alias("gender"), F.array_join(found["ethnicity"], "|").alias("ethnicity"))


@query("page_insurers", """
SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN 'aetna|blue_cross' WHEN 1 THEN 'optum' WHEN 2 THEN '' END AS insurers,
  CASE WHEN c_nationkey % 4 < 3 THEN c_acctbal > 0 END AS sliding
FROM customer
""")
def page_insurers(spark, folder):
    """Insurers and the sliding flag from the JSON in a page's script; a page without it has neither."""
    n, name = F.col("c_nationkey") % 4, F.col("c_name")
    listed = (F.when(n == 0, F.array(_said("AETNA of ", name), F.lit("Anthem Blue Cross"), F.lit("Blue Cross Blue Shield")))
              .when(n == 1, F.array(_said(name, " Optum"), name)).otherwise(F.array(name)))
    profile = F.struct((F.col("c_acctbal") > 0).alias("slidingScale"), listed.alias("insuranceCompaniesList"))
    blob = F.to_json(F.struct(F.struct(F.struct(profile.alias("profile")).alias("pageProps")).alias("props")))
    html = F.when(n < 3, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), blob, F.lit("</script>"))).otherwise("<p>none</p>")
    found = H.embedded_profile(html)
    return table(spark, folder, "customer").select(
        "c_custkey", F.array_join(H.providers_from_names(found["insurers"]), "|").alias("insurers"), found["sliding"].alias("sliding"))


@query("appended_logs", with_(SEARCHES, FEEDBACK) + """
SELECT 'searches' AS log, created_at::DATE AS day, count(*) AS n, count(*) FILTER (filtered_count > 2) AS marked FROM searches GROUP BY ALL
UNION ALL SELECT 'feedback', created_at::DATE, count(*), count(*) FILTER (event_type = 'explicit') FROM feedback GROUP BY ALL
""")
def appended_logs(spark, folder):
    """Two appends to each log, read back by day; feedback without a type is explicit."""
    searches, feedback = T.shared_dir(spark, "searches"), T.shared_dir(spark, "feedback")
    asked, given = search_log(spark, folder), feedback_log(spark, folder).withColumnRenamed("item", "therapist_id")
    given = given.withColumn("event_type", F.when(F.col("event_type") != "explicit", F.col("event_type")))
    for half in (0, 1):
        T.append_searches(asked.where(F.col("id") % 2 == half), searches)
        T.append_feedback(given.where(F.col("query_id") % 2 == half).withColumn("id", F.lit("f")), feedback)
    def days(name, path, marked):
        rows = spark.read.parquet(path)
        return rows.groupBy(F.lit(name).alias("log"), F.col("created_date").alias("day")).agg(F.count("*").alias("n"), F.count(F.when(marked, 1)).alias("marked"))
    return days("searches", searches, F.col("filtered_count") > 2).unionByName(days("feedback", feedback, F.col("event_type") == "explicit"))


@query("knowledge_rows", """
SELECT s_name AS concern, s_nationkey % 5 AS n, 'm' || k AS modality, round(s_suppkey % 7 / 10.0 + k / 100.0, 4)::DOUBLE AS strength
FROM supplier, range(0, 3) r(k)
""")
def knowledge_rows(spark, folder):
    """A knowledge file of concerns and their modalities, read by Spark; keys that begin with ``_`` are notes."""
    key = F.col("s_suppkey")
    weights = F.concat(F.lit("{"), F.array_join(F.transform(F.array(*map(F.lit, range(3))), lambda k: F.format_string('"m%d": %.4f', k, key % 7 / 10 + k / 100)), ", "), F.lit("}"))
    entry = F.concat(F.lit('"'), F.col("s_name"), F.lit('": '), weights)
    rows = table(spark, folder, "supplier")
    file = rows.agg(F.concat(F.lit('{"_note": {"x": 1}, '), F.array_join(F.array_sort(F.collect_list(entry)), ", "), F.lit("}")).alias("value"))
    found = read_knowledge(spark, _written(file, spark, "knowledge"))
    nation = rows.select(F.col("s_name").alias("concern"), (F.col("s_nationkey") % 5).alias("n"))
    return found.join(nation, "concern").select("concern", "n", "modality", F.round("strength", 4).alias("strength"))
