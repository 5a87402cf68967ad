"""Filters, relaxation and the blocked scans against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.operators import filters as P
from matchweave.operators.clean import FILTER_FIELDS
from matchweave.operators.nearest import approximate_topk, candidate_topk, nearest_search, vector_topk
from matchweave.operators.relax import (
    GENERIC_NOTE, choose_level, ladder_counts, relaxation_note, searchable)
from matchweave.plans import search as S
from matchweave.sources.knowledge import Knowledge
from matchweave.sources.tables import PROFILE_SCHEMA, QUERY_SCHEMA

CITIES, GENDERS = ["Fresno", "Oakland", "Davis"], ["Woman", "Man", None]
POPULATIONS = ["Adults", "Children (6-10)", "Adolescents / Teenagers (14 - 19)", "Elders"]


def some(rng, values, p=0.5):
    return [v for v in values if rng.random() < p]


def make_profiles(spark, rng, n=60):
    rows = []
    for i in range(n):
        vector = [rng.gauss(0, 1) for _ in range(4)]
        rows.append({
            "id": f"p{i:03d}", "source": "s", "source_url": f"http://x/{i}", "source_id": str(i), "name": f"Name {i}",
            "credentials": ["LMFT"], "gender": rng.choice(GENDERS), "ethnicity": some(rng, ["White", "Hispanic or Latino"]),
            "modalities": some(rng, vocab.MODALITIES, 0.2), "specializations": some(rng, ["anxiety", "grief"]),
            "populations_served": some(rng, POPULATIONS), "languages": some(rng, ["english", "spanish"]),
            "city": rng.choice(CITIES + [None]), "state": rng.choice(["CA", "CA", "CA", "NV"]),
            "zip_code": rng.choice(["90001", "90002", None]), "session_formats": some(rng, vocab.SESSION_FORMATS, 0.4),
            "insurance_providers": some(rng, ["aetna", "cigna"]), "sliding_scale": rng.random() < 0.2,
            "fee_min": rng.choice([None, 60, 120, 200]), "fee_max": 250,
            "accepting_new_clients": rng.random() < 0.8, "bio": f"Gentle words about anxiety number {i} and grief",
            "rating": None, "review_count": i, "profile_completeness": None,
            "embedding": vector if rng.random() < 0.9 else None, "is_active": True})
    names = PROFILE_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], PROFILE_SCHEMA), rows


def make_queries(spark, rng, n=40):
    rows = []
    for i in range(n):
        def maybe(values, p=0.4):
            return rng.choice(values) if rng.random() < p else None
        rows.append({
            "query_id": f"q{i:02d}", "free_text": "anxiety and grief", "concerns": ["anxiety"],
            "embedding": [rng.gauss(0, 1) for _ in range(4)], "city": maybe(["fresno", "OAKLAND", "Nowhere"]),
            "zip_code": maybe(["90001", "90009"], 0.2),
            "insurance": maybe(["aetna", "kaiser", "self_pay", "sliding_scale"]),
            "session_format": maybe(vocab.SESSION_FORMATS), "max_budget": maybe([0, 50, 100]),
            "preferred_gender": maybe(["woman", "robot"]), "preferred_language": maybe(["Spanish", "klingon"]),
            "preferred_ethnicity": maybe(["white", "martian"]),
            "age_group": maybe(["child", "Adult", "adolescent", "senior"])})
    names = QUERY_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], QUERY_SCHEMA), rows


# ---------------------------------------------------------------- naive re-query loop
def like_any(values, patterns):
    return any(p.strip("%") in v.lower() for v in values for p in patterns)


def passes(c, p):
    if p["state"] != "CA" or not p["accepting_new_clients"] or p["embedding"] is None:
        return False
    if c["city"] and (p["city"] or "").lower() != c["city"].lower():
        return False
    if c["zip_code"] and p["zip_code"] != c["zip_code"]:
        return False
    ins = c["insurance"]
    if ins and ins != "self_pay" and not p["sliding_scale"] and (
            ins == "sliding_scale" or ins not in p["insurance_providers"]):
        return False
    fmt = c["session_format"]
    if fmt and fmt != "both" and fmt not in p["session_formats"] and "both" not in p["session_formats"]:
        return False
    if c["max_budget"] and p["fee_min"] is not None and p["fee_min"] > c["max_budget"] and not p["sliding_scale"]:
        return False
    if c["preferred_gender"] and (p["gender"] or "").lower() != c["preferred_gender"].lower():
        return False
    if c["preferred_ethnicity"] and c["preferred_ethnicity"].lower() not in [e.lower() for e in p["ethnicity"]]:
        return False
    if c["preferred_language"] and c["preferred_language"].lower() not in p["languages"]:
        return False
    patterns = vocab.AGE_GROUP_PATTERNS.get((c["age_group"] or "").lower())
    return not patterns or like_any(p["populations_served"], patterns)


STEPS = [("max_budget",), ("session_format",), ("insurance",), ("city", "zip_code"), ("preferred_gender",),
         ("preferred_ethnicity",), ("preferred_language",)]


def naive(query, profiles):
    """(level, ids) of the ladder, one query per step."""
    c = dict(query)
    hits = [p for p in profiles if passes(c, p)]
    if len(hits) >= 3:
        return 0, hits, 100
    for level, fields in enumerate(STEPS, start=1):
        if not c[fields[0]]:
            continue
        for f in fields:
            c[f] = None
        hits = [p for p in profiles if passes(c, p)]
        if len(hits) >= 3:
            return level, hits, 100
    c = {k: None for k in c} | {"age_group": query["age_group"]}
    return 8, [p for p in profiles if passes(c, p)], 20


def nearest(query, hits, k):
    q = np.array(query["embedding"])
    def distance(p):
        v = np.array(p["embedding"], dtype=np.float32).astype(float)
        w = np.array(q, dtype=np.float32).astype(float)
        return round(1 - v @ w / (np.linalg.norm(v) * np.linalg.norm(w)), 9)
    return [p["id"] for p in sorted(hits, key=lambda p: (distance(p), p["id"]))[:k]]


@pytest.mark.parametrize("seed, small", [(1, False), (2, False), (3, True)])
def test_ladder_and_candidates_match_requery_loop(spark, seed, small):
    rng = random.Random(seed)
    profiles, people = make_profiles(spark, rng)
    queries, asked = make_queries(spark, rng)
    pool = searchable(profiles)
    chosen = choose_level(queries, ladder_counts(queries, pool, **({"criteria_per_block": 5, "signatures_per_slice": 7} if small else {})))
    got = {r.query_id: r for r in chosen.collect()}
    want = {q["query_id"]: naive(q, people) for q in asked}
    assert {k: (r.level, r.filtered_count) for k, r in got.items()} == {
        k: (level, min(len(hits), cap)) for k, (level, hits, cap) in want.items()}
    ready = chosen.withColumns({"demands": P.query_demands(), "max_budget": F.coalesce("max_budget", F.lit(0))})
    pairs = candidate_topk(ready, pool, **({"cell_rows": 4, "queries_per_block": 5, "items_per_slice": 3} if small else {}))
    lists = {}
    for r in pairs.orderBy("query_id", "rank").collect():
        lists.setdefault(r.query_id, []).append(r.id)
    assert lists == {q["query_id"]: nearest(q, want[q["query_id"]][1], want[q["query_id"]][2])
                     for q in asked if want[q["query_id"]][1]}


def test_column_predicates_match_naive(spark):
    rng = random.Random(7)
    profiles, people = make_profiles(spark, rng, 30)
    queries, asked = make_queries(spark, rng, 20)
    q = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns])
    rows = q.join(profiles, how="cross")
    preds = P.Predicates(lambda n: F.col(f"q_{n}"), F.col)
    got = {(r[0], r[1]) for r in rows.where(preds.all()).select("q_query_id", "id").collect()}
    assert got == {(a["query_id"], p["id"]) for a in asked for p in people if passes(a, p)}
    for a in asked[:5]:
        single = {r.id for r in P.filter_profiles(profiles, a).where(F.col("embedding").isNotNull()).collect()}
        assert single == {p["id"] for p in people if passes(a, p)}


def test_literal_filters_reach_the_scan(spark, tmp_path):
    profiles, _ = make_profiles(spark, random.Random(1), 5)
    profiles.write.parquet(str(tmp_path / "p"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = P.filter_profiles(spark.read.parquet(str(tmp_path / "p")), {"zip_code": "90001"}).select("id")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(state,CA)" in text and "EqualTo(zip_code,90001)" in text and "embedding" not in text.split("ReadSchema")[1]


def test_adding_a_criterion_never_widens_the_search(spark):
    rng = random.Random(9)
    profiles, _ = make_profiles(spark, rng)
    base = {r.id for r in P.filter_profiles(profiles, {"insurance": "aetna"}).collect()}
    more = {r.id for r in P.filter_profiles(profiles, {"insurance": "aetna", "city": "Fresno"}).collect()}
    assert more <= base


def note(spark, level, **criteria):
    names = ["city", "insurance", "session_format", "max_budget", "preferred_gender",
             "preferred_language", "preferred_ethnicity"]
    row = spark.range(1).select(*[F.lit(criteria.get(n)).cast("int" if n == "max_budget" else "string").alias(n)
                                  for n in names])
    return row.select(relaxation_note(F.lit(level)).alias("n")).first().n


def test_notes(spark):
    assert note(spark, 0, city="Fresno") == ""
    assert note(spark, 8) == GENERIC_NOTE
    assert note(spark, 4, max_budget=90, city="Fresno", insurance="blue_cross", preferred_gender="woman").endswith(
        "by removing your budget limit ($90), your insurance filter (Blue Cross) and your location filter (Fresno).")
    assert note(spark, 1, max_budget=90).endswith("by removing your budget limit ($90).")


def vectors(rng, n, kind=lambda rng: [rng.gauss(0, 1) for _ in range(3)]):
    return [(i, [1.0, 0.0, 0.0] if i % 3 == 0 else kind(rng)) for i in range(n)]


def plain_topk(queries, items, k):
    """The k nearest by (distance, key); vectors without a direction are at 2."""
    out = {}
    for q, v in queries:
        rows = []
        for i, w in items:
            if w is not None:
                a, b = (np.array(x if x is not None else [0.0], np.float32).astype(float) for x in (v, w))
                sized = np.isfinite(a).all() and np.isfinite(b).all() and np.linalg.norm(a) > 0 and np.linalg.norm(b) > 0 and len(a) == len(b)
                rows.append((round(1 - a @ b / (np.linalg.norm(a) * np.linalg.norm(b)), 9) + 0.0 if sized else 2.0, i))
        out[q] = [(i, d) for d, i in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("options", [{}, {"cell_rows": 9}, {"cell_rows": 20, "queries_per_block": 4, "items_per_slice": 10}, {"cell_rows": 1, "max_pivots": 3}])
def test_nearest_equals_all_pairs_with_hot_values(spark, options):
    """Copies of one vector fill a third of the table; null, zero and odd vectors come last, and no query loses rows."""
    rng = random.Random(3)
    rows = vectors(rng, 300) + [(1000, None), (1001, [0.0, 0.0, 0.0]), (1002, [float("nan"), 1.0, 0.0]), (1003, [-1.0, 0.0, 0.0])]
    asked = [(i, [rng.gauss(0, 1) for _ in range(3)]) for i in range(9)] + [(99, [1.0, 0.0, 0.0]), (100, None), (101, [0.0] * 3)]
    items = spark.createDataFrame(rows, "id int, embedding array<float>")
    queries = spark.createDataFrame(asked, "query_id int, embedding array<float>")
    for k in (7, 400):
        got = {}
        for r in vector_topk(queries, items, k, **options).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.id, r.distance))
        want = plain_topk(asked, rows, k)
        assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
        assert all(d == pytest.approx(e) for q in got for (_, d), (_, e) in zip(got[q], want[q]))
    assert [i for i, _ in want[99]][:7] == [0, 3, 6, 9, 12, 15, 18] and [i for i, _ in want[100]][:3] == [0, 1, 2]


def test_pruning_leaves_pairs_out(spark):
    """Vectors in tight groups: most cells are never visited, and the answer is the same."""
    rng = random.Random(8)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.02) for x in centres[i % 30]]) for i in range(1500)]
    items = spark.createDataFrame(rows, "id int, embedding array<float>")
    queries = spark.createDataFrame([(i, rows[i * 7][1]) for i in range(40)], "query_id int, embedding array<float>")
    search = nearest_search(queries, items, 10, cell_rows=25)
    work = search.share().first()
    assert work.pairs == 60_000 and work.cells > 10 and work.scored < 0.35 * work.pairs
    got = {}
    for r in search.run().orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == {q: [i for i, _ in v] for q, v in plain_topk([(i, rows[i * 7][1]) for i in range(40)], rows, 10).items()}


def test_recall_of_random_projections(spark):
    rng = random.Random(4)
    items = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(400)], "id int, embedding array<float>")
    queries = items.where("id < 60").withColumnRenamed("id", "query_id")
    exact = {(r.query_id, r.id) for r in vector_topk(queries, items, 5).collect()}
    found = approximate_topk(queries, items, 5).collect()
    assert len({(r.query_id, r.id) for r in found} & exact) >= 0.9 * len(exact) and max(r.rank for r in found) <= 5


def test_random_projections_keep_pairs_out_of_the_shuffle(spark):
    """Blocks of queries meet slices of items; the best that share a bucket, copies of a row once."""
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(700)]
    items = spark.createDataFrame(rows + rows[:5], "id int, embedding array<float>")
    found = approximate_topk(items.withColumnRenamed("id", "query_id"), items, 5)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.distance))
    want = plain_topk(rows, rows, 5)
    assert len(got) == 700 and all(sorted(v)[0][1:] == (q, 0.0) and len(v) == 5 for q, v in got.items())
    assert sum(len({i for _, i, _ in got[q]} & {i for i, _ in want[q]}) for q in got) >= 0.9 * 5 * 700


@pytest.mark.parametrize("options", [{}, {"cell_rows": 40}])
def test_nearest_items_send_little(spark, options):
    """No vector is sent once for each cell it visits: a few copies, whatever the pivots."""
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(16)]) for i in range(3000)]
    items = spark.createDataFrame(rows, "id int, embedding array<float>")
    search = nearest_search(items.withColumnRenamed("id", "query_id"), items, 3, **options)
    slices = max(first + parts for first, parts in search.places.values())
    assert slices * search.blocks <= 4 * spark.sparkContext.defaultParallelism and (len(search.cells) > 40) == bool(options)
    assert (search._first() if options else search._everywhere()).count() == 3000 * (1 if options else slices)


def test_nearest_of_nothing(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert vector_topk(queries.limit(0), items, 3).count() == vector_topk(queries, items.limit(0), 3).count() == 0


def test_search_end_to_end(spark):
    rng = random.Random(5)
    profiles, people = make_profiles(spark, rng)
    queries, asked = make_queries(spark, rng, 12)
    described = spark.createDataFrame([(m, [rng.gauss(0, 1) for _ in range(4)]) for m in vocab.MODALITIES[:5]],
                                      "modality string, embedding array<double>")
    chosen, pairs = S.candidates(queries, profiles)
    ranked = S.rank_candidates(chosen, pairs, profiles, described, Knowledge().weights(spark))
    rows = S.results(ranked).collect()
    assert len(ranked.select("query_id").distinct().collect()) == sum(bool(naive(q, people)[1]) for q in asked)
    assert all(0 <= r.composite_score <= 1 and 1 <= r.rank <= 10 for r in rows)
    assert len(rows[0].asDict()) == 21 and all(r.match_explanation.startswith("[SCORES]") for r in rows)
    log = {r.id: r for r in S.search_log(chosen, ranked).collect()}
    assert len(log) == 12
    for q in asked:
        ids = [r.therapist_id for r in sorted((r for r in rows if r.query_id == q["query_id"]), key=lambda r: r.rank)]
        assert log[q["query_id"]].result_ids == ids


def test_ranking_does_not_depend_on_row_order(spark):
    rng = random.Random(11)
    profiles, _ = make_profiles(spark, rng)
    queries, _ = make_queries(spark, rng, 6)
    described = spark.createDataFrame([("emdr", [1.0, 0.0, 0.0, 0.0])], "modality string, embedding array<double>")

    def ranks(p, q):
        out = S.search(q, p, described, Knowledge().weights(spark))
        return sorted((r.query_id, r.rank, r.id, r.composite_score) for r in out.collect())

    assert ranks(profiles, queries) == ranks(profiles.orderBy(F.rand(1)).repartition(3), queries.orderBy(F.rand(2)))


def test_similarities_of_matched_modalities(spark):
    rows = spark.createDataFrame(
        [(1, "a", [3.0, 4.0], ["emdr", "nope"]), (1, "b", [0.0, 1.0], []), (2, "a", [1.0, 0.0], ["emdr", "somatic"])],
        "query_id int, id string, embedding array<float>, matched_modalities array<string>")
    described = spark.createDataFrame([("emdr", [1.0, 0.0]), ("somatic", [0.6, 0.8]), ("emdr", [0.0, 1.0])],
                                      "modality string, embedding array<double>")
    out = S.add_similarities(rows, described)
    got = {(r.query_id, r.id): [round(s, 6) for s in sorted(r.similarities)] for r in out.collect()}
    assert got == {(1, "a"): [0.6], (1, "b"): [], (2, "a"): [0.6, 1.0]}


def test_requests_become_searches(spark):
    """Merged filters, left-out empty requests, vectors of texts once each, stored ones reused; a failed text keeps its search."""
    seen = spark.sparkContext.accumulator(0)

    def encoder(texts):
        seen.add(len(texts))
        if any("broken" in t for t in texts):
            raise ValueError("no")
        return [[float(len(t)), 1.0] for t in texts]

    kinds = ", ".join(f"{f}: {'int' if f == 'max_budget' else 'string'}" for f in FILTER_FIELDS)
    pick = lambda **v: tuple(v.get(f) for f in FILTER_FIELDS)
    rows = [("a", "help me", pick(city="Davis"), pick(city="Fresno", max_budget=90), None), ("b", "help me", pick(), pick(), None),
            ("c", " ", pick(insurance="aetna"), pick(), None), ("d", "", pick(), pick(), None), ("e", None, pick(), pick(), None),
            ("f", "known", pick(), pick(), None), ("g", "given", pick(), pick(), [7.0, 7.0])]
    requests = spark.createDataFrame(rows, f"query_id string, free_text string, explicit struct<{kinds}>, inferred struct<{kinds}>, embedding array<float>")
    stored = spark.createDataFrame([("known", [5.0, 5.0])], "t string, embedding array<float>").select(F.sha2("t", 256).alias("text_hash"), "embedding")
    got = {r.query_id: r for r in S.ask(requests, encoder, stored).collect()}
    assert set(got) == {"a", "b", "c", "f", "g"} and (got["a"].city, got["a"].max_budget) == ("Davis", 90)
    assert [list(got[q].embedding) for q in "abcfg"] == [[7.0, 1.0], [7.0, 1.0], [16.0, 1.0], [5.0, 5.0], [7.0, 7.0]]
    assert seen.value == 2
    broken = requests.limit(1).withColumn("free_text", F.lit("broken"))
    assert [r.embedding for r in S.ask(broken, encoder).collect()] == [None]
    described = S.description_vectors(spark, encoder).collect()
    assert len(described) == len(vocab.MODALITIES) and {r.modality for r in described} == set(vocab.MODALITIES)


def test_search_with_null_and_zero_vectors(spark):
    """Every search with admissible profiles has rows, whatever its vector; profiles with a zero vector come last."""
    rng = random.Random(21)
    profiles, people = make_profiles(spark, rng)
    zero = F.transform("embedding", lambda x: x * 0)
    profiles = profiles.withColumn("embedding", F.when(F.xxhash64("id") % 5 == 0, zero).otherwise(F.col("embedding")))
    queries, asked = make_queries(spark, rng, 9)
    odd = queries.withColumn("embedding", F.when(F.col("query_id") == asked[0]["query_id"], F.lit(None)).when(
        F.col("query_id") == asked[1]["query_id"], zero).otherwise(F.col("embedding")))
    described = spark.createDataFrame([("emdr", [1.0, 0.0, 0.0, 0.0])], "modality string, embedding array<double>")
    rows = S.search(odd, profiles, described, Knowledge().weights(spark)).collect()
    counts = {}
    for r in rows:
        counts[r.query_id] = counts.get(r.query_id, 0) + 1
        assert 0 <= r.composite_score <= 1
    assert counts == {q["query_id"]: min(10, len(naive(q, people)[1]), naive(q, people)[2]) for q in asked if naive(q, people)[1]}
