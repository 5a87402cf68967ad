"""Profile fields from the landed pages."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import table, tags_sql
from matchweave import vocab
from matchweave.functions.text import distinct_ignoring_case, strip_tags
from matchweave.operators import extract as H
from matchweave.operators.changes import page_closed

# Visible text as the element pass sees it, for SQL: scripts, styles, comments and tags out.
_TEXT = (r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, '(?is)<script\b[^>]*>.*?</script\s*>', ' ', 'g'), "
         r"'(?is)<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))")
_UNESCAPED = ("replace(replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), "
              "'&nbsp;', ' '), '&amp;', '&')")
TEXT = _UNESCAPED.format(t=_TEXT.format(h="html"))


def _pages(spark, folder):
    return table(spark, folder, "pages")


@query("page_text", rf"SELECT page_id, md5(trim(regexp_replace({TEXT}, '\s+', ' ', 'g'))) AS digest FROM pages")
def page_text(spark, folder):
    return _pages(spark, folder).select("page_id", F.md5(strip_tags(F.col("html"))).alias("digest"))


_TITLE = _UNESCAPED.format(t="regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")
TITLE = f"string_split(trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')), ' | ')[1]"
NAME = (f"trim(regexp_replace(trim(array_to_string(list_transform(string_split({TITLE}, ','), lambda x: trim(x)), ', ')), "
        "'^,+|,+$', '', 'g'))")


@query("page_names_and_credentials", f"SELECT page_id, {TITLE} AS title, {NAME} AS name, '' AS credentials FROM pages")
def page_names_and_credentials(spark, folder):
    """The invented titles hold no credentials; title_parts has some."""
    title = H.page_title(F.col("html"))
    return _pages(spark, folder).select(
        "page_id", title.alias("title"), H.name_from_title(title).alias("name"),
        F.array_join(H.credentials_from_title(title), ",").alias("credentials"))


@query("page_titles", f"SELECT page_id, {TITLE} AS title FROM pages")
def page_titles(spark, folder):
    return _pages(spark, folder).select("page_id", H.page_title(F.col("html")).alias("title"))


@query("title_parts", """
SELECT c_custkey, trim(c_name) || ', ' || 'Therapist' AS name, ['LMFT', 'PhD'] AS credentials FROM customer
""")
def title_parts(spark, folder):
    title = F.concat("c_name", F.lit(" ,  Therapist, LMFT PhD, "), F.col("c_mktsegment"))
    rows = table(spark, folder, "customer").repartition(spark.sparkContext.defaultParallelism)  # a file may be one task
    return rows.select(
        "c_custkey", H.name_from_title(title).alias("name"), H.credentials_from_title(title).alias("credentials"))


@query("page_element_tree")
def page_element_tree(spark, folder):
    """Sections, prose and longest paragraph of every page, and both bios built from them."""
    return H.page_pieces(_pages(spark, folder), key="page_id").select(
        "page_id", F.size("sections").alias("n_sections"), F.length("paragraph").alias("paragraph_chars"),
        F.length("page_text").alias("n_chars"), H.bio_from_sections().alias("section_bio"),
        H.bio_from_about().alias("about_bio"), H.section("insurance")["text"].alias("insurance_text"))


@query("page_blocks", """
SELECT page_id, 'my groups' AS heading, l || ' club,Teens ' || page_id AS items, 'Insurance Takes ' || l || ' plans & Fee ' || page_id AS insurance,
  'Takes ' || l || ' plans & Fee ' || page_id AS insurance_body, 'Fees from $' || page_id AS fee_text, page_id % 5 = 0 AS telehealth,
  CASE WHEN page_id % 2 = 0 THEN 'I have worked for ' || page_id || ' years with people of all kinds' END AS section_bio,
  CASE WHEN page_id % 3 = 0 THEN 'I listen first and work with you for as long as it takes, in ' || l || ' or in any other tongue, number ' || page_id END AS about_bio
FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS l FROM pages)
""")
def page_blocks(spark, folder):
    """Titled sections, prose, fees and badges, which the pages lack, put into each with words of its own."""
    lang, number = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1), F.col("page_id").cast("string")
    put = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    blocks = put(
        '<div class="mb-6"><h3>My Groups</h3><ul><li>', lang, ' club</li><li>Teens ', number, '</li></ul></div>',
        '<div class="mb-6"><script>not shown</script><h2>Insurance</h2><p>Takes ', lang, ' plans &amp;</p><p>Fee ', number, "</p></div>",
        '<div class="fee">Fees from $', number, "</div>",
        F.when(F.col("page_id") % 5 == 0, '<span class="telehealth">on</span>').otherwise(""),
        F.when(F.col("page_id") % 2 == 0, put('<div class="whitespace-pre-line">I have worked for ', number, " years with people of all kinds</div>")).otherwise(""),
        F.when(F.col("page_id") % 3 == 0, put('<div class="box2-content">About Jane I listen first and work with you for as long as it takes, in ', lang,
                                              " or in any other tongue, number ", number, "</div>")).otherwise(""))
    found = H.page_pieces(_pages(spark, folder).withColumn("html", F.concat("html", blocks)), key="page_id")
    groups, insurance = H.section("groups"), H.section("insurance")
    return found.select(
        "page_id", groups["heading"].alias("heading"), F.array_join(groups["items"], ",").alias("items"), insurance["text"].alias("insurance"),
        insurance["body"].alias("insurance_body"), "fee_text", F.col("telehealth_badge").alias("telehealth"),
        F.when(F.col("page_id") % 2 == 0, H.bio_from_sections()).alias("section_bio"),
        F.when(F.col("page_id") % 3 == 0, H.bio_from_about()).alias("about_bio"))


# Words of the invented texts stand for some keywords, one of them for a tag already there.
_SPECIAL_WORDS = vocab.SPECIALIZATION_KEYWORDS + [("and", "grief"), ("un", "ptsd"), ("der", "grief"), ("ver", "career")]


@query("page_specialization_tags", f"""
SELECT doc_id, array_to_string(tags, ',') AS tags FROM (SELECT doc_id, {tags_sql("lower(text)", _SPECIAL_WORDS)} AS tags FROM documents)
""")
def page_specialization_tags(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(H.specialization_tags(F.col("text"), _SPECIAL_WORDS), ",").alias("tags"))


_INSURER_CASE = "CASE " + " ".join(
    f"WHEN contains(lower(x), '{k}') THEN '{t}'" for k, t in vocab.INSURER_NAMES) + " END"


@query("insurers_from_names", f"""
SELECT c_custkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS providers FROM (
  SELECT c_custkey, list_filter(list_transform(n, lambda x: {_INSURER_CASE}), lambda x: x IS NOT NULL) AS l FROM (
    SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN ['Anthem Blue Cross', 'BlueCross of ' || c_name, 'Aetna']
      WHEN 'BUILDING' THEN ['Optum/United Behavioral', 'Optum Health', 'Kaiser ' || c_name] WHEN 'HOUSEHOLD' THEN ['Unknown ' || c_name]
      ELSE ['Blue Shield of California', 'CIGNA'] END AS n FROM customer))
""")
def insurers_from_names(spark, folder):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    names = (F.when(seg == "MACHINERY", F.array(F.lit("Anthem Blue Cross"), F.concat(F.lit("BlueCross of "), name), F.lit("Aetna")))
             .when(seg == "BUILDING", F.array(F.lit("Optum/United Behavioral"), F.lit("Optum Health"), F.concat(F.lit("Kaiser "), name)))
             .when(seg == "HOUSEHOLD", F.array(F.concat(F.lit("Unknown "), name)))
             .otherwise(F.array(F.lit("Blue Shield of California"), F.lit("CIGNA"))))
    return table(spark, folder, "customer").select(
        "c_custkey", F.array_join(H.providers_from_names(names), ",").alias("providers"))


_SEGMENT_TEXT = """CASE c_mktsegment WHEN 'MACHINERY' THEN 'I do not accept insurance. ' || c_name
  WHEN 'BUILDING' THEN 'Aetna, United and sliding scale fees ' || c_name WHEN 'AUTOMOBILE' THEN 'Out-of-Network only ' || c_name
  WHEN 'HOUSEHOLD' THEN 'Private pay ' || c_name ELSE c_name END"""


@query("insurance_from_text", f"""
SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'self_pay' WHEN 'BUILDING' THEN 'aetna,united_healthcare'
  WHEN 'AUTOMOBILE' THEN 'out_of_network' WHEN 'HOUSEHOLD' THEN 'self_pay' ELSE '' END AS providers,
  contains(lower({_SEGMENT_TEXT}), 'sliding') AS sliding FROM customer
""")
def insurance_from_text(spark, folder):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    text = (F.when(seg == "MACHINERY", F.concat(F.lit("I do not accept insurance. "), name))
            .when(seg == "BUILDING", F.concat(F.lit("Aetna, United and sliding scale fees "), name))
            .when(seg == "AUTOMOBILE", F.concat(F.lit("Out-of-Network only "), name))
            .when(seg == "HOUSEHOLD", F.concat(F.lit("Private pay "), name)).otherwise(name))
    found = H.insurance_from_text(text)
    return table(spark, folder, "customer").select(
        "c_custkey", F.array_join(found["providers"], ",").alias("providers"), found["sliding"].alias("sliding"))


@query("page_session_format", f"""
SELECT page_id, CASE WHEN online AND office THEN 'both' WHEN online THEN 'telehealth' ELSE 'in_person' END AS format FROM (
  SELECT page_id, regexp_matches(t, 'telehealth|online therapy|video sessions|virtual sessions|the re') AS online, regexp_matches(t, 'in-person|in person|office|nd on') AS office
  FROM (SELECT page_id, lower({TEXT}) AS t FROM pages))
""")
def page_session_format(spark, folder):
    """Two syllable pairs of the invented texts stand for the phrases the pages lack."""
    text = F.regexp_replace(F.lower(strip_tags(F.col("html"))), "the re", "telehealth the re")
    text = F.regexp_replace(text, "nd on", "office nd on")
    return _pages(spark, folder).select("page_id", F.get(H.session_format(text), F.lit(0)).alias("format"))


_FEE_SQL = r"\$\s*(\d{2,4})(?:\s*[-–]\s*\$?\s*(\d{2,4}))?"


@query("fee_ranges", rf"""
SELECT p_partkey, TRY_CAST(nullif(regexp_extract(m, '{_FEE_SQL}', 1), '') AS INTEGER) AS fee_min,
  TRY_CAST(coalesce(nullif(regexp_extract(m, '{_FEE_SQL}', 2), ''), nullif(regexp_extract(m, '{_FEE_SQL}', 1), '')) AS INTEGER) AS fee_max
FROM (SELECT p_partkey, coalesce(
    CASE WHEN p_type = 'SMALL' THEN nullif(regexp_extract('Fee: $ ' || p_size * 10 || ' - $' || p_size * 20, '{_FEE_SQL}'), '') END,
    list_filter(regexp_extract_all(page, '{_FEE_SQL}'), lambda x: CAST(regexp_extract(x, '\d+') AS INTEGER) BETWEEN 20 AND 1000)[1]) AS m
  FROM (SELECT *, 'From $' || (p_size * 40) || ' to $15 or $' || p_size || '0–' || p_size || '5 each' AS page FROM part))
""")
def fee_ranges(spark, folder):
    size = F.col("p_size")
    text = F.when(F.col("p_type") == "SMALL", F.concat(
        F.lit("Fee: $ "), (size * 10).cast("string"), F.lit(" - $"), (size * 20).cast("string")))
    s = size.cast("string")
    page = F.concat(F.lit("From $"), (size * 40).cast("string"), F.lit(" to $15 or $"), s, F.lit("0–"), s, F.lit("5 each"))
    return table(spark, folder, "part").withColumn("fee", H.fee_range(text, page)).select(
        "p_partkey", "fee.fee_min", "fee.fee_max")


@query("accepting_flags", """
SELECT conv_id, turn, CASE role WHEN 'system' THEN FALSE WHEN 'assistant' THEN TRUE ELSE NOT lower(text) LIKE '%on%' END AS accepting,
  lower(text) LIKE '%the on%' AS closed FROM conversations
""")
def accepting_flags(spark, folder):
    role, text = F.col("role"), F.lower("text")
    badge = F.when(role == "system", "Not accepting").when(role == "assistant", "Accepting now")
    page = F.when(F.contains(text, F.lit("on")), F.concat(text, F.lit(" NOT accepting new clients"))).otherwise(text)
    audit = F.when(F.contains(text, F.lit("the on")), F.concat(text, F.lit(" Closed to New Clients"))).otherwise(text)
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", H.accepting(page, badge).alias("accepting"), page_closed(audit).alias("closed"))


def _with_breadcrumb(spark, folder):
    """Pages with the breadcrumb they lack, its city taken from the language part of the address."""
    lang = F.regexp_extract("url", "^https?://[^/]+/([a-z]+)/", 1)
    crumb = F.concat(F.lit('<a href="/therapists/ca/'), lang, F.lit('-town">up</a>'))
    return _pages(spark, folder).withColumn("html", F.concat("html", crumb))


@query("page_cities", """
SELECT page_id, upper(l[1]) || l[2:] || ' Town' AS city FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS l FROM pages)
""")
def page_cities(spark, folder):
    place = H.city_from_page(F.col("html"), strip_tags(F.col("html")))
    return _with_breadcrumb(spark, folder).select("page_id", place["city"].alias("city"))


@query("population_lists", """
SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i), '|') AS populations FROM (
  SELECT p_partkey, CASE WHEN p_size < 25 THEN [upper(p_name), p_name, p_type] ELSE list_transform(string_split(p_name || ', ' || upper(p_name) || ',' || p_brand, ','), lambda x: trim(x)) END AS l FROM part)
""")
def population_lists(spark, folder):
    name = F.col("p_name")
    items = F.when(F.col("p_size") < 25, F.array(F.upper(name), name, F.lit("  "), F.col("p_type"), F.repeat(name, 20)))
    text = F.concat(name, F.lit(", "), F.upper(name), F.lit(",,"), F.col("p_brand"))
    return table(spark, folder, "part").select(
        "p_partkey", F.array_join(H.populations(items, text), "|").alias("populations"))


_L = "Native American, Indigenous, or Alaska Native"


@query("label_lists", f"""
SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 'White|{_L}|' || c_name WHEN 'BUILDING' THEN '{_L}|White|Foo'
  WHEN 'AUTOMOBILE' THEN c_name || '|Hispanic or Latino' WHEN 'HOUSEHOLD' THEN '' ELSE 'Asian or Asian American' END AS labels FROM customer
""")
def label_lists(spark, folder):
    seg, name = F.col("c_mktsegment"), F.col("c_name")
    text = (F.when(seg == "MACHINERY", F.concat(F.lit(f"White, {_L.upper()}, "), name))
            .when(seg == "BUILDING", F.lit(f"{_L}, white, Foo")).when(seg == "AUTOMOBILE", F.concat(name, F.lit(", hispanic or latino ")))
            .when(seg == "HOUSEHOLD", F.lit("")).otherwise(F.lit("asian or asian american")))
    return table(spark, folder, "customer").select("c_custkey", F.array_join(H.split_labels(text), "|").alias("labels"))


_LINKS = r"""
found AS (
  SELECT DISTINCT url AS page, 'http://site.example' || h AS link FROM (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref=["'']([^"'']+)["'']', 1)) AS h FROM pages))
"""


def _links(spark, folder):
    return H.links(_pages(spark, folder), "http://site.example/")


@query("page_links", f"WITH {_LINKS} SELECT page, link FROM found")
def page_links(spark, folder):
    return _links(spark, folder)


@query("distinct_links_by_shape", f"WITH {_LINKS} SELECT DISTINCT link FROM found WHERE link LIKE '%/the%' OR link LIKE '%/de%'")
def distinct_links_by_shape(spark, folder):
    found = _links(spark, folder)
    return H.union_links(H.profile_links(found, "/the"), H.profile_links(found, "/de"))


# Forms of a reference, by the page's number: relative, with dots, a query, a fragment, a host of its own.
_FORMS = ["../{0}", "./{0}?page=2", "?page=2", "#top", "//other.example/{0}", "{0}/../more/./x#part", "https://s.example/../{0}", "../../{0}//y/", "/{0}/.."]


@query("resolved_links", f"""
WITH refs AS (
  SELECT url, CASE {' '.join(f"WHEN page_id % {len(_FORMS)} = {i} THEN replace('{f}', '{{0}}', ltrim(h, '/'))" for i, f in enumerate(_FORMS))} END AS ref
  FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*?\\bhref=["'']([^"'']+)["'']', 1)) AS h FROM pages)),
parts AS (
  SELECT url, regexp_replace(ref, '#.*', '') AS ref, regexp_extract(url, '^[a-z]+:', 0) AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*', 0) AS root,
    regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\\?[^#]*', 0) AS asked FROM refs),
split AS (
  SELECT *, regexp_extract(ref, '\\?.*', 0) AS asks, regexp_extract(ref, '^[^?]*', 0) AS ref_path FROM parts),
named AS (
  SELECT *, string_split(CASE WHEN ref_path LIKE '/%' THEN ref_path ELSE regexp_replace(regexp_replace(path, '[^/]*$', '') || ref_path, '/+', '/', 'g') END, '/') AS names
  FROM split),
folded AS (
  SELECT *, list_reduce(list_prepend('', list_transform(names[2:], lambda n: '/' || n)), lambda done, n:
    CASE n WHEN '/.' THEN done WHEN '/..' THEN regexp_replace(done, '/[^/]*$', '') ELSE done || n END) || CASE WHEN names[-1] IN ('.', '..') THEN '/' ELSE '' END AS full_path
  FROM named)
SELECT DISTINCT url AS page, CASE WHEN ref LIKE 'http%' THEN ref WHEN ref LIKE '//%' THEN scheme || ref
  WHEN ref_path = '' THEN root || path || CASE WHEN asks = '' THEN asked ELSE asks END ELSE root || full_path || asks END AS link
FROM folded
""")
def resolved_links(spark, folder):
    """References of many forms against the address of their page."""
    number = F.col("page_id") % len(_FORMS)
    form = F.element_at(F.array(*[F.lit(f) for f in _FORMS]), (number + 1).cast("int"))
    pages = _pages(spark, folder).select("page_id", "url", F.transform(
        F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref=[\"']([^\"']+)[\"']"), F.lit(1)), lambda h: F.replace(
            form, F.lit("{0}"), F.regexp_extract(h, "^/*(.*)$", 1))).alias("refs"))
    html = F.array_join(F.transform("refs", lambda r: F.concat(F.lit('<a href="'), r, F.lit('">x</a>'))), "")
    return H.links(pages.select("url", html.alias("html")))


@query("distinct_words_ignoring_case", """
SELECT conv_id, turn, len(list_distinct(list_transform(string_split(text, ' '), lambda x: lower(x)))) AS n FROM conversations
""")
def distinct_words_ignoring_case(spark, folder):
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", F.size(distinct_ignoring_case(F.split("text", " "))).cast("bigint").alias("n"))


_PAGE_FEE = f"list_filter(regexp_extract_all({TEXT}, '{_FEE_SQL}'), lambda x: CAST(regexp_extract(x, '\\d+') AS INTEGER) BETWEEN 20 AND 1000)[1]"


@query("page_profiles", f"""
SELECT 'pages' AS source, url AS source_url, string_split(regexp_replace(url, '/+$', ''), '/')[-1] AS source_id, {NAME} AS name,
  '' AS credentials, '' AS tags, '' AS populations, upper(l[1]) || l[2:] || ' Town' AS city, 'CA' AS state, NULL::VARCHAR AS zip_code,
  CASE WHEN online AND office THEN 'both' WHEN online THEN 'telehealth' ELSE 'in_person' END AS session_format, '' AS insurance, FALSE AS sliding_scale,
  TRY_CAST(nullif(regexp_extract(fee, '{_FEE_SQL}', 1), '') AS INTEGER) AS fee_min,
  TRY_CAST(coalesce(nullif(regexp_extract(fee, '{_FEE_SQL}', 2), ''), nullif(regexp_extract(fee, '{_FEE_SQL}', 1), '')) AS INTEGER) AS fee_max,
  NOT contains(t, 'not accepting new clients') AS accepting_new_clients, '' AS bio, 0.0::DOUBLE AS profile_completeness
FROM (SELECT *, regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS l, regexp_matches(t, 'telehealth|online therapy') AS online,
    regexp_matches(t, 'in-person|in person|office') AS office, {_PAGE_FEE} AS fee
  FROM (SELECT *, lower({TEXT}) AS t FROM pages)) WHERE {NAME} <> ''
""")
def page_profiles(spark, folder):
    """Every field of every page at once; the pages have no titled sections, so no tags or bio."""
    def joined(column):
        return F.array_join(column, ",")

    rows = H.page_profiles(_with_breadcrumb(spark, folder), "pages")
    return rows.select(
        "source", "source_url", "source_id", "name", joined("credentials").alias("credentials"),
        joined(F.concat("modalities", "specializations")).alias("tags"), joined("populations_served").alias("populations"),
        "city", "state", "zip_code", joined("session_formats").alias("session_format"),
        joined("insurance_providers").alias("insurance"), "sliding_scale", "fee_min", "fee_max", "accepting_new_clients",
        "bio", "profile_completeness")
