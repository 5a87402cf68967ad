"""Concern mapping, relaxation, ranking signals and the whole batch search."""

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.retrieval_queries import label_centres
from catalog.standins import ASKED, PROFILES, profiles, searches_asked, table, tags_sql, with_
from matchweave import vocab
from matchweave.operators import rank as R
from matchweave.operators.bm25 import candidate_scores
from matchweave.operators.clean import FILTER_FIELDS, coerce_profiles, search_document
from matchweave.operators.concerns import (
    modality_weights, normalize_concern, tag_concerns, top_modalities, wanted_modalities)
from matchweave.operators.embed import HashingEncoder
from matchweave.operators.extract import modality_tags
from matchweave.operators.relax import GENERIC_NOTE, NOTE_START, choose_level, ladder_counts, searchable
from matchweave.plans import search as S
from matchweave.sources.knowledge import Knowledge, concern_catalogue


def quoted(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


_MAP_ROWS = ", ".join(
    f"({quoted(c)}, {i}, {quoted(m)}, {j}, {s}::DOUBLE)" for i, (c, ms) in enumerate(vocab.KNOWLEDGE.items())
    for j, (m, s) in enumerate(ms.items()))
_ALIAS_ROWS = ", ".join(f"({quoted(a)}, {quoted(c)})" for a, c in vocab.ALIASES.items())

CONCERNS = f"""
knowledge(concern, ord, modality, mod_ord, strength) AS (VALUES {_MAP_ROWS}),
keys AS (SELECT DISTINCT concern, ord FROM knowledge),
aliases(phrase, concern) AS (VALUES {_ALIAS_ROWS}),
named AS (
  SELECT query_id, u.pos - 1 AS pos, u.c AS raw,
    trim(regexp_replace(lower(trim(u.c)), '[^a-z0-9]+', '_', 'g'), '_') AS slug
  FROM asked, unnest(list_zip(concerns, range(1, len(concerns) + 1))) AS t(z),
    LATERAL (SELECT z[1] AS c, z[2] AS pos) u
),
normal AS (
  SELECT n.query_id, n.pos, n.raw, coalesce(a.concern, k.concern,
    (SELECT min_by(concern, ord) FROM keys x WHERE contains(n.slug, x.concern) OR contains(x.concern, n.slug)),
    n.raw) AS concern
  FROM named n LEFT JOIN aliases a ON a.phrase = lower(trim(n.raw)) LEFT JOIN keys k ON k.concern = n.slug
),
best AS (
  SELECT query_id, modality, max(strength) AS w, min(pos * 1000 + mod_ord) AS ord
  FROM normal JOIN knowledge USING (concern) GROUP BY ALL
),
wanted AS (SELECT query_id, modality, ord, w / max(w) OVER (PARTITION BY query_id) AS weight FROM best)
"""

LADDER = """
pool AS (SELECT * FROM profiles WHERE state = 'CA' AND accepting_new_clients AND embedding IS NOT NULL),
need AS (
  SELECT q.query_id, p.id, greatest(
    CASE WHEN coalesce(q.max_budget, 0) = 0 OR p.fee_min IS NULL OR p.fee_min <= q.max_budget OR p.sliding_scale THEN 0 ELSE 1 END,
    CASE WHEN q.session_format IS NULL OR q.session_format = 'both' OR list_contains(p.session_formats, q.session_format)
      OR list_contains(p.session_formats, 'both') THEN 0 ELSE 2 END,
    CASE WHEN q.insurance IS NULL OR q.insurance = 'self_pay' OR p.sliding_scale
      OR list_contains(p.insurance_providers, q.insurance) THEN 0 ELSE 3 END,
    CASE WHEN q.city IS NULL OR lower(p.city) = lower(q.city) THEN 0 ELSE 4 END,
    CASE WHEN q.zip_code IS NULL OR p.zip_code = q.zip_code THEN 0 WHEN q.city IS NOT NULL THEN 4 ELSE 8 END,
    CASE WHEN q.preferred_gender IS NULL OR lower(p.gender) = lower(q.preferred_gender) THEN 0 ELSE 5 END,
    CASE WHEN q.preferred_ethnicity IS NULL OR list_contains(list_transform(p.ethnicity, lambda x: lower(x)), lower(q.preferred_ethnicity)) THEN 0 ELSE 6 END,
    CASE WHEN q.preferred_language IS NULL OR list_contains(p.languages, lower(q.preferred_language)) THEN 0 ELSE 7 END) AS need
  FROM asked q, pool p
  WHERE CASE lower(q.age_group)
    WHEN 'child' THEN len(list_filter(p.populations_served, lambda x: x ILIKE '%child%' OR x ILIKE '%toddler%' OR x ILIKE '%preteen%' OR x ILIKE '%tween%')) > 0
    WHEN 'adolescent' THEN len(list_filter(p.populations_served, lambda x: x ILIKE '%adolescent%' OR x ILIKE '%teen%' OR x ILIKE '%tween%')) > 0
    WHEN 'adult' THEN len(list_filter(p.populations_served, lambda x: x ILIKE '%adult%' OR x ILIKE '%elder%')) > 0
    ELSE TRUE END
),
have AS (
  SELECT q.query_id, l.lv, count(n.id) AS c
  FROM asked q CROSS JOIN (SELECT unnest(range(0, 9)) AS lv) l
  LEFT JOIN need n ON n.query_id = q.query_id AND n.need <= l.lv GROUP BY ALL
),
level AS (
  SELECT query_id, min(lv) AS level FROM have JOIN asked USING (query_id)
  WHERE lv = 8 OR (c >= 3 AND (lv = 0 OR (lv = 1 AND coalesce(max_budget, 0) <> 0) OR (lv = 2 AND session_format IS NOT NULL)
    OR (lv = 3 AND insurance IS NOT NULL) OR (lv = 4 AND city IS NOT NULL) OR (lv = 5 AND preferred_gender IS NOT NULL)
    OR (lv = 6 AND preferred_ethnicity IS NOT NULL) OR (lv = 7 AND preferred_language IS NOT NULL)))
  GROUP BY query_id
),
candidates AS (
  SELECT query_id, id, distance FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rn FROM (
      SELECT n.query_id, n.id, level, round(1 - list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[])
        / (sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))
          * sqrt(list_inner_product(p.embedding::DOUBLE[], p.embedding::DOUBLE[]))), 9) AS distance
      FROM need n JOIN level USING (query_id) JOIN asked q USING (query_id) JOIN pool p USING (id)
      WHERE n.need <= level AND q.embedding IS NOT NULL)
  ) WHERE rn <= CASE WHEN level = 8 THEN 20 ELSE 100 END
)
"""

#: Labels of the stand-in vectors; each stands for every tenth modality.
_LABELS_OF_VECTORS = 10
_DESCRIBED = ", ".join(f"({i % _LABELS_OF_VECTORS}, {quoted(m)})" for i, m in enumerate(vocab.MODALITIES))

SIGNALS = f"""
described(label, modality) AS (VALUES {_DESCRIBED}),
descriptions AS (
  SELECT modality, list(m ORDER BY pos) AS vec FROM (
    SELECT label, pos, avg(v) AS m FROM (
      SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)
    GROUP BY ALL) JOIN described USING (label) GROUP BY modality
),
texts AS (
  SELECT id, string_split_regex(lower(concat_ws(' ', name, bio, array_to_string(list_filter(specializations, lambda x: x <> 'not_a_tag'), ' '),
    array_to_string(modalities, ' '), array_to_string(populations_served, ' '), array_to_string(credentials, ' '))), '\\s+') AS toks
  FROM profiles WHERE id IN (SELECT id FROM candidates)
),
doc_terms AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(toks) AS term FROM texts) WHERE term <> '' GROUP BY ALL),
sized AS (
  SELECT query_id, id, dl, count(*) OVER w AS n, avg(dl) OVER w AS avgdl
  FROM candidates JOIN (SELECT id, len(list_filter(toks, lambda x: x <> '')) AS dl FROM texts) USING (id)
  WINDOW w AS (PARTITION BY query_id)
),
query_terms AS (
  SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(string_split_regex(lower(free_text), '\\s+')) AS term FROM asked)
  WHERE term <> '' GROUP BY ALL
),
hits AS (
  SELECT query_id, id, qtf, tf, dl, n, avgdl, count(*) OVER (PARTITION BY query_id, term) AS df
  FROM sized JOIN query_terms USING (query_id) JOIN doc_terms USING (id, term)
),
keyword AS (
  SELECT query_id, id, sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM hits GROUP BY ALL
),
pairs AS (SELECT c.*, p.modalities, p.embedding, p.city, p.rating, p.review_count, p.profile_completeness
  FROM candidates c JOIN profiles p USING (id)),
modality AS (
  SELECT query_id, id,
    least(1.0, coalesce(sum(CASE WHEN list_contains(modalities, modality) THEN weight END), 0) / sum(weight)) AS share,
    coalesce(string_agg(CASE WHEN list_contains(modalities, modality) AND weight > 0.5 THEN modality END, ',' ORDER BY ord), '') AS matched,
    avg(CASE WHEN list_contains(modalities, modality) AND weight > 0.5 AND vec IS NOT NULL THEN
      list_inner_product(embedding::DOUBLE[], vec) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-8) END) AS sim
  FROM pairs JOIN wanted USING (query_id) LEFT JOIN descriptions USING (modality) GROUP BY ALL
),
raw AS (
  SELECT p.query_id, p.id, p.distance, coalesce(m.matched, '') AS matched,
    coalesce(m.share, 0) AS share, CASE WHEN sim IS NULL THEN 1.0 ELSE 0.5 + 0.5 * greatest(0.0, sim) END AS corroboration,
    CASE WHEN len(p.modalities) <= 5 THEN 1.0 ELSE ln(8) / ln(len(p.modalities) + 3) END AS breadth,
    1 - p.distance AS semantic, coalesce(k.bm25, 0) AS bm25,
    0.6 * coalesce((p.rating - 1) / 4 * least(1.0, ln(1 + p.review_count) / ln(101)), 0) + 0.4 * p.profile_completeness AS quality,
    CASE WHEN a.city IS NULL THEN NULL WHEN lower(coalesce(p.city, '')) = lower(a.city) THEN 1.0 ELSE 0.0 END AS location
  FROM pairs p JOIN asked a USING (query_id) LEFT JOIN modality m USING (query_id, id) LEFT JOIN keyword k USING (query_id, id)
),
scaled AS (
  SELECT *, share * corroboration * breadth AS modality_raw FROM raw
),
normalised AS (
  SELECT *,
    CASE WHEN max(modality_raw) OVER w = min(modality_raw) OVER w THEN 0.5 ELSE (modality_raw - min(modality_raw) OVER w) / (max(modality_raw) OVER w - min(modality_raw) OVER w) END AS n_modality,
    CASE WHEN max(semantic) OVER w = min(semantic) OVER w THEN 0.5 ELSE (semantic - min(semantic) OVER w) / (max(semantic) OVER w - min(semantic) OVER w) END AS n_semantic,
    CASE WHEN max(bm25) OVER w = min(bm25) OVER w THEN 0.5 ELSE (bm25 - min(bm25) OVER w) / (max(bm25) OVER w - min(bm25) OVER w) END AS n_bm25,
    CASE WHEN max(quality) OVER w = min(quality) OVER w THEN 0.5 ELSE (quality - min(quality) OVER w) / (max(quality) OVER w - min(quality) OVER w) END AS n_quality
  FROM scaled WINDOW w AS (PARTITION BY query_id)
),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY composite DESC, distance, id) AS INTEGER) AS rank FROM (
    SELECT *, round(CASE WHEN location IS NULL THEN 0.40 * n_modality + 0.35 * n_semantic + 0.15 * n_bm25 + 0.10 * n_quality
      ELSE 0.35 * n_modality + 0.30 * n_semantic + 0.13 * n_bm25 + 0.07 * n_quality + 0.15 * location END, 4) AS composite
    FROM normalised)
)
"""

FULL = with_(PROFILES, ASKED, CONCERNS, LADDER, SIGNALS)


def asked_concerns(spark, folder):
    return searches_asked(spark, folder).select("query_id", F.posexplode("concerns").alias("pos", "concern"))


def descriptions(spark, folder):
    """Modality description vectors: the mean vector of a label stands for some modalities."""
    names = F.array(*[F.array(*map(F.lit, vocab.MODALITIES[n::_LABELS_OF_VECTORS])) for n in range(_LABELS_OF_VECTORS)])
    centres = label_centres(table(spark, folder, "embeddings"))
    return centres.select(F.explode(F.get(names, F.col("label"))).alias("modality"), F.col("mean").alias("embedding"))


def _candidates(spark, folder):
    asked, people = searches_asked(spark, folder), profiles(spark, folder)
    chosen, pairs = S.candidates(asked, people)
    return chosen, pairs, people


# ---------------------------------------------------------------- concerns
@query("concern_normalisation", with_(ASKED, CONCERNS) + "SELECT query_id, raw, concern FROM normal")
def concern_normalisation(spark, folder):
    return asked_concerns(spark, folder).select(
        "query_id", F.col("concern").alias("raw"), normalize_concern(F.col("concern")).alias("concern"))


@query("concern_modality_weights", with_(ASKED, CONCERNS)
       + "SELECT query_id, modality, round(weight, 6) AS weight FROM wanted")
def concern_modality_weights(spark, folder):
    weights = modality_weights(asked_concerns(spark, folder), Knowledge().weights(spark))
    return weights.select("query_id", "modality", F.round("weight", 6).alias("weight"))


@query("top_modalities_per_search", with_(ASKED, CONCERNS) + """
SELECT query_id, modality, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, modality) AS rank FROM wanted) WHERE rank <= 5
""")
def top_modalities_per_search(spark, folder):
    weights = modality_weights(asked_concerns(spark, folder), Knowledge().weights(spark))
    return top_modalities(weights, 5).select("query_id", "modality", "rank")


@query("concerns_known_in_searches", with_(ASKED, CONCERNS) + """
SELECT concern, count(DISTINCT query_id) AS searches FROM normal WHERE concern IN (SELECT concern FROM keys) GROUP BY concern
""")
def concerns_known_in_searches(spark, folder):
    known = concern_catalogue(Knowledge().weights(spark))
    named = asked_concerns(spark, folder).withColumn("concern", normalize_concern(F.col("concern")))
    return named.join(known, "concern", "left_semi").groupBy("concern").agg(
        F.count_distinct("query_id").alias("searches"))


_TEXT_KNOWLEDGE = Knowledge(
    vocab.KNOWLEDGE,
    {"the": "anxiety", "und die": "grief", "with the": "trauma", "les": "grief", "of the": "work_stress",
     "que": "depression", "thatin": "insomnia"})
_PHRASES = [(k.replace("_", " "), k) for k in _TEXT_KNOWLEDGE.concerns] + list(_TEXT_KNOWLEDGE.aliases.items())


@query("concern_tags_in_text", f"""
SELECT doc_id, array_to_string(tags, ',') AS concerns FROM (
  SELECT doc_id, {tags_sql("t", [(f" {p} ", c) for p, c in _PHRASES])} AS tags FROM (
    SELECT doc_id, ' ' || lower(trim(regexp_replace(text, '[^\\p{{L}}\\p{{N}}'']+', ' ', 'g'))) || ' ' AS t FROM documents))
""")
def concern_tags_in_text(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(tag_concerns(F.col("text"), _TEXT_KNOWLEDGE), ",").alias("concerns"))


# ---------------------------------------------------------------- ladder
_LABELS = """
    CASE WHEN level >= 1 AND coalesce(max_budget, 0) <> 0 THEN 'your budget limit ($' || max_budget || ')' END,
    CASE WHEN level >= 2 AND session_format IS NOT NULL THEN 'your session format preference' END,
    CASE WHEN level >= 3 AND insurance IS NOT NULL THEN 'your insurance filter (' ||
      array_to_string(list_transform(string_split(insurance, '_'), lambda w: upper(w[1]) || w[2:]), ' ') || ')' END,
    CASE WHEN level >= 4 AND city IS NOT NULL THEN 'your location filter (' || city || ')' END,
    CASE WHEN level >= 5 AND preferred_gender IS NOT NULL THEN 'your gender preference (' || preferred_gender || ')' END,
    CASE WHEN level >= 6 AND preferred_ethnicity IS NOT NULL THEN 'your ethnicity preference (' || preferred_ethnicity || ')' END,
    CASE WHEN level >= 7 AND preferred_language IS NOT NULL THEN 'your language preference (' || upper(preferred_language[1]) || lower(preferred_language[2:]) || ')' END
"""


@query("relaxation_ladder", with_(PROFILES, ASKED, LADDER) + f"""
SELECT query_id, CAST(level AS INTEGER) AS level, least(c, CASE WHEN level = 8 THEN 20 ELSE 100 END) AS filtered_count,
  CASE WHEN level = 0 THEN '' WHEN len(l) = 0 THEN {quoted(GENERIC_NOTE)}
    ELSE {quoted(NOTE_START)} || CASE WHEN len(l) = 1 THEN l[1] ELSE array_to_string(l[1:-2], ', ') || ' and ' || l[-1] END || '.' END AS note
FROM (SELECT query_id, level, c, list_filter([{_LABELS}], lambda x: x IS NOT NULL) AS l
  FROM level JOIN asked USING (query_id) JOIN have h ON h.query_id = asked.query_id AND h.lv = level.level)
""")
def relaxation_ladder(spark, folder):
    asked, pool = searches_asked(spark, folder), searchable(profiles(spark, folder))
    return choose_level(asked, ladder_counts(asked, pool)).select("query_id", "level", "filtered_count", "note")


@query("ladder_counts_per_level", with_(PROFILES, ASKED, LADDER)
       + "SELECT query_id, CAST(need AS INTEGER) AS need, count(*) AS n FROM need GROUP BY ALL")
def ladder_counts_per_level(spark, folder):
    return ladder_counts(searches_asked(spark, folder), searchable(profiles(spark, folder)))


@query("search_candidates", with_(PROFILES, ASKED, LADDER)
       + "SELECT query_id, id, distance + 0 AS distance FROM candidates")
def search_candidates(spark, folder):
    return _candidates(spark, folder)[1]


# ---------------------------------------------------------------- signals
@query("candidate_keyword_scores", FULL + "SELECT query_id, id, round(bm25, 5) AS bm25 FROM raw")
def candidate_keyword_scores(spark, folder):
    chosen, pairs, people = _candidates(spark, folder)
    docs = coerce_profiles(people).select("id", search_document().alias("document"))
    return candidate_scores(pairs, chosen, docs).withColumn("bm25", F.round("bm25", 5))


@query("modality_signal", FULL + """
SELECT query_id, id, round(share, 5) AS share, matched, round(corroboration, 5) AS corroboration, round(breadth, 5) AS breadth FROM raw
""")
def modality_signal(spark, folder):
    chosen, pairs, people = _candidates(spark, folder)
    wanted = wanted_modalities(asked_concerns(spark, folder), Knowledge().weights(spark))
    rows = (pairs.join(wanted, "query_id", "left")
            .join(coerce_profiles(people).select("id", "modalities", "embedding"), "id"))
    matched = R.matched_modalities(F.col("wanted"), F.col("modalities"))
    rows = S.add_similarities(rows.withColumn("matched_modalities", matched), descriptions(spark, folder), "seen")
    return rows.select(
        "query_id", "id", F.round(R.modality_match(F.col("wanted"), F.col("modalities")), 5).alias("share"),
        F.array_join("matched_modalities", ",").alias("matched"), F.round(R.corroboration(F.col("seen")), 5).alias("corroboration"),
        F.round(R.breadth_penalty(F.size("modalities")), 5).alias("breadth"))


@query("quality_signal", with_(PROFILES) + """
SELECT id, round(0.6 * coalesce((rating - 1) / 4 * least(1.0, ln(1 + review_count) / ln(101)), 0) + 0.4 * profile_completeness, 6) AS quality
FROM profiles
""")
def quality_signal(spark, folder):
    return profiles(spark, folder).select("id", F.round(
        R.quality(F.col("rating"), F.col("review_count"), F.col("profile_completeness")), 6).alias("quality"))


def _ranked(spark, folder, limit):
    return S.search(searches_asked(spark, folder), profiles(spark, folder), descriptions(spark, folder),
                    Knowledge().weights(spark), limit=limit)


@query("hybrid_ranking_all_candidates", FULL + """
SELECT query_id, id, rank, composite AS composite_score, round(n_modality, 4) AS modality_score, round(n_semantic, 4) AS semantic_score,
  round(n_bm25, 4) AS bm25_score, round(n_quality, 4) AS quality_score, location AS location_score FROM ranked
""")
def hybrid_ranking_all_candidates(spark, folder):
    return _ranked(spark, folder, None).select(
        "query_id", "id", "rank", "composite_score", *[F.round(s, 4).alias(s) for s in R.SIGNALS], "location_score")


@query("asked_requests", with_(ASKED) + """,
requests AS (
  SELECT query_id, coalesce(city, CASE WHEN query_id % 2 = 0 THEN 'NATION_1' END) AS city, coalesce(insurance, 'optum') AS insurance,
    CASE WHEN query_id % 3 = 0 THEN 'therapist search' ELSE free_text END AS text FROM asked),
words AS (SELECT query_id, unnest(string_split_regex(lower(text), '\\s+')) AS w FROM requests),
cells AS (SELECT query_id, ('0x' || md5(w)[:4])::INT % 16 AS cell, count(*) AS n FROM words WHERE w <> '' GROUP BY ALL)
SELECT query_id, city, insurance, cell, round((n / sqrt(sum(n * n) OVER (PARTITION BY query_id)))::FLOAT::DOUBLE, 5) AS weight
FROM cells JOIN requests USING (query_id)
""".replace(" ,\nrequests", ",\nrequests"))
def asked_requests(spark, folder):
    """Raw requests to searches: explicit filters over inferred ones, and the vector of each text, a fixed phrase for none."""
    rows = searches_asked(spark, folder).drop("embedding")
    given, none = ["city", "insurance"], [f for f in FILTER_FIELDS if f not in ("city", "insurance")]
    kind = {"max_budget": "int"}
    null = lambda f: F.lit(None).cast(kind.get(f, "string")).alias(f)
    raw = rows.select(
        "query_id", F.when(F.col("query_id") % 3 == 0, "  ").otherwise(F.col("free_text")).alias("free_text"),
        F.struct(*given, *[null(f) for f in none]).alias("explicit"),
        F.struct(F.when(F.col("query_id") % 2 == 0, "NATION_1").alias("city"), F.lit("optum").alias("insurance"), *[null(f) for f in none]).alias("inferred"))
    asked = S.ask(raw, HashingEncoder(16))
    cells = asked.select("query_id", "city", "insurance", F.posexplode("embedding").alias("cell", "weight")).where("weight > 0")
    return cells.withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query("hybrid_search", FULL + """
SELECT query_id, id, rank, composite AS composite_score, matched,
  CASE WHEN rank = 1 THEN 'Strong fit' WHEN rank <= 3 THEN 'Good fit' WHEN rank <= 6 THEN 'Decent fit' ELSE 'Possible match' END AS fit,
  CASE WHEN composite >= 0.8 THEN 'Excellent' WHEN composite >= 0.6 THEN 'Good' WHEN composite >= 0.4 THEN 'Moderate' ELSE 'Low' END AS band
FROM ranked WHERE rank <= 10
""")
def hybrid_search(spark, folder):
    return _ranked(spark, folder, vocab.RESULT_LIMIT).select(
        "query_id", "id", "rank", "composite_score", F.array_join("matched_modalities", ",").alias("matched"), "fit",
        R.score_band(F.col("composite_score")).alias("band"))


@query("hybrid_search_results")
def hybrid_search_results(spark, folder):
    """The 18-field result rows with both explanation texts."""
    return S.results(_ranked(spark, folder, vocab.RESULT_LIMIT))


@query("search_log_rows", FULL + """
SELECT a.query_id AS id, least(h.c, CASE WHEN level = 8 THEN 20 ELSE 100 END) AS filtered_count, coalesce(ids, '') AS result_ids, FALSE AS cache_hit,
  '{"concerns":[' || array_to_string(list_transform(a.concerns, lambda c: '"' || c || '"'), ',') || ']}' AS extracted_intent
FROM asked a JOIN level USING (query_id) JOIN have h ON h.query_id = a.query_id AND h.lv = level.level
LEFT JOIN (SELECT query_id, string_agg(id, ',' ORDER BY rank) AS ids FROM ranked WHERE rank <= 10 GROUP BY 1) r ON r.query_id = a.query_id
""")
def search_log_rows(spark, folder):
    chosen, pairs, people = _candidates(spark, folder)
    ranked = S.rank_candidates(chosen, pairs, people, descriptions(spark, folder), Knowledge().weights(spark))
    return S.search_log(chosen, ranked).select(
        "id", "filtered_count", F.array_join("result_ids", ",").alias("result_ids"), "cache_hit", "extracted_intent")


@query("offered_and_missed_modalities", with_(PROFILES, ASKED, CONCERNS) + """
SELECT o.o_orderkey, string_agg(CASE WHEN list_contains(p.modalities, w.modality) THEN w.modality END, ',' ORDER BY w.modality) AS hit,
  string_agg(CASE WHEN NOT list_contains(p.modalities, w.modality) THEN w.modality END, ',' ORDER BY w.modality) AS missed
FROM orders o JOIN profiles p ON p.id = o.o_custkey JOIN asked a ON a.query_id = o.o_custkey JOIN wanted w ON w.query_id = a.query_id
GROUP BY o.o_orderkey
""")
def offered_and_missed_modalities(spark, folder):
    wanted = wanted_modalities(asked_concerns(spark, folder), Knowledge().weights(spark))
    names = F.transform("wanted", lambda e: e["modality"])
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("id"))
    rows = (orders.join(profiles(spark, folder).select("id", "modalities"), "id")
            .join(wanted.withColumnRenamed("query_id", "id"), "id"))

    def listed(items):
        return F.nullif(F.array_join(F.array_sort(items), ","), F.lit(""))

    return rows.select("o_orderkey", listed(F.array_intersect(names, "modalities")).alias("hit"),
                       listed(F.array_except(names, "modalities")).alias("missed"))


_MODALITY_WORDS = vocab.MODALITY_KEYWORDS + [(" the ", "emdr"), (" und ", "somatic"), (" of ", "emdr")]


@query("modality_keyword_tags", f"""
SELECT doc_id, array_to_string(tags, ',') AS tags FROM (
  SELECT doc_id, {tags_sql("' ' || lower(text) || ' '", _MODALITY_WORDS)} AS tags
  FROM documents)
""")
def modality_keyword_tags(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.array_join(modality_tags(F.col("text"), _MODALITY_WORDS), ",").alias("tags"))
