"""Snapshots after upserts, audits, enrichment and corrections; ingestion; embedding."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.operators import changes as C
from matchweave.operators.embed import HashingEncoder, embed, embed_changed, query_text
from matchweave.plans.ingestion import cap_per_group, ingest, stage_counts, union_sources, write_ingested
from matchweave.sources import tables as T
from matchweave.sources.knowledge import Knowledge, concern_catalogue, read_knowledge

def now():
    return F.lit("2024-06-01").cast("timestamp")


OLD = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
COLUMNS = ("id string, source string, source_url string, name string, city string, gender string, ethnicity array<string>, "
           "insurance_providers array<string>, sliding_scale boolean, fee_min int, accepting_new_clients boolean, "
           "is_active boolean, last_updated timestamp")


def profile(i, **over):
    row = {"id": f"p{i}", "source": "s", "source_url": f"u{i}", "name": f"n{i}", "city": "Davis", "gender": None,
           "ethnicity": [], "insurance_providers": ["aetna"], "sliding_scale": False, "fee_min": 90,
           "accepting_new_clients": True, "is_active": True, "last_updated": OLD} | over
    return tuple(row.values())


def base(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_upsert(spark):
    changes = spark.createDataFrame(
        [("x1", "u1", "first", "Reno", 10, 1), ("x1", "u1", "last", "Reno", 20, 2), ("x9", "u9", "new", "Chico", 30, 1)],
        "id string, source_url string, name string, city string, fee_min int, _seq int")
    after = by_id(C.upsert(base(spark, profile(1), profile(2)), changes, now=now()))
    assert set(after) == {"p1", "p2", "x9"}
    assert (after["p1"].name, after["p1"].city, after["p1"].fee_min) == ("last", "Davis", 20)
    assert (after["x9"].city, after["x9"].name) == ("Chico", "new")
    assert after["p1"].last_updated.month == 6 and after["p2"].last_updated.month == 1 and after["p2"].name == "n2"


def test_upsert_with_one_key_in_most_changes(spark):
    changes = spark.range(5000).select(
        F.when(F.col("id") < 4000, "u1").otherwise(F.concat(F.lit("k"), F.col("id"))).alias("source_url"),
        F.col("id").cast("string").alias("name"), F.col("id").alias("_seq"))
    after = C.upsert(base(spark, profile(1)), changes, now=now())
    assert after.count() == 1001 and after.where("source_url = 'u1'").first().name == "3999"


def test_soft_delete_keeps_rows(spark):
    gone = spark.createDataFrame([("p1",), ("p1",), ("zz",)], "id string")
    after = by_id(C.soft_delete(base(spark, profile(1), profile(2)), gone, now=now()))
    assert (after["p1"].is_active, after["p1"].accepting_new_clients, after["p2"].is_active) == (False, False, True)


def test_audit(spark):
    rows = [profile(1), profile(2), profile(3), profile(4), profile(5, accepting_new_clients=False), profile(6),
            profile(7, is_active=False), profile(8)]
    pages = spark.createDataFrame(
        [("u1", 404, ""), ("u2", 500, ""), ("u3", 403, ""), ("u4", 200, "No Longer Accepting"), ("u5", 200, "welcome"),
         ("u6", 200, "welcome"), ("u7", 404, "")], "source_url string, status int, text string")
    after, outcomes = C.audit(base(spark, *rows), pages, now=now())
    got = {r.source_url: r.outcome for r in outcomes.collect()}
    assert got == {"u1": "deleted", "u2": "error", "u3": "ok", "u4": "deactivated", "u5": "activated", "u6": "ok", "u8": "error"}
    after = by_id(after)
    assert [(after[f"p{i}"].is_active, after[f"p{i}"].accepting_new_clients) for i in range(1, 8)] == [
        (False, False), (True, True), (True, True), (True, False), (True, True), (True, True), (False, True)]


def test_fill_missing(spark):
    rows = [profile(1), profile(2), profile(3, gender="Man"), profile(4, gender="Man", ethnicity=["White"]),
            profile(5), profile(6), profile(7, source="other")]
    found = spark.createDataFrame(
        [("p1", True, "Woman", ["White"]), ("p2", True, "Woman", []), ("p3", True, None, None), ("p4", True, "Woman", []),
         ("p5", False, None, None), ("p7", True, "Woman", [])], "id string, ok boolean, gender string, ethnicity array<string>")
    after, outcomes = C.fill_missing(base(spark, *rows), found, source="s", now=now())
    assert {r.id: r.outcome for r in outcomes.collect()} == {
        "p1": "updated", "p2": "partial", "p3": "no_data", "p5": "error", "p6": "error"}
    after = by_id(after)
    assert (after["p1"].gender, after["p1"].ethnicity) == ("Woman", ["White"])
    assert (after["p4"].gender, after["p7"].gender, after["p2"].gender) == ("Man", None, "Woman")


def test_overwrite_insurance(spark):
    found = spark.createDataFrame([("p1", ["optum"], True), ("p2", [], False)],
                                  "id string, insurance_providers array<string>, sliding_scale boolean")
    after, outcomes = C.overwrite_insurance(base(spark, profile(1), profile(2), profile(3)), found, source="s", now=now())
    assert {r.outcome: r.n for r in C.outcome_counts(outcomes).collect()} == {"updated": 1, "no_data": 1, "error": 1}
    assert [by_id(after)[f"p{i}"].insurance_providers for i in (1, 2, 3)] == [["optum"], [], ["aetna"]]


def test_corrections(spark):
    df = spark.createDataFrame([("Los Angles",), ("Los Angles",), ("Paris",), ("Fresno",), (None,)], "city string")
    assert {tuple(r) for r in C.preview_corrections(df, "city").collect()} == {("Los Angles", "Los Angeles", 2), ("Paris", None, 1)}
    fixed = df.withColumn("city", C.correct_value(F.col("city")))
    assert sorted(r.city or "" for r in fixed.collect()) == ["", "", "Fresno", "Los Angeles", "Los Angeles"]
    assert C.remaining_dirty(fixed, "city").first().n == 0


# ---------------------------------------------------------------- knowledge
def test_knowledge_from_file(spark, tmp_path):
    text = json.dumps({"_comment": "x", **vocab.KNOWLEDGE, "_aliases": vocab.ALIASES}, indent=1)
    (tmp_path / "map.json").write_text(text)
    rows = read_knowledge(spark, str(tmp_path / "map.json"))
    want = Knowledge().weights(spark)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert concern_catalogue(rows).count() == 25
    assert Knowledge.from_json(text) == Knowledge()


# ---------------------------------------------------------------- embedding and ingestion
def test_embedding_batches(spark):
    df = spark.createDataFrame([(i, f"word{i} text") for i in range(150)], "id int, text string").coalesce(1)

    def flaky(texts):
        if "word70 text" in texts:
            raise RuntimeError("model down")
        return HashingEncoder(8)(texts)

    out = {r.id: r for r in embed(df, "id", "text", flaky).collect()}
    failed = [i for i, r in out.items() if not r.embedding]
    assert len(out) == 150 and 70 in failed and len(failed) == 64 and out[70].error == "model down"
    assert np.linalg.norm(out[min(set(out) - set(failed))].embedding) == pytest.approx(1, abs=1e-6)


def test_unchanged_texts_are_not_encoded_again(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")
    first = embed_changed(df, spark.createDataFrame([], "id int, embedding array<float>, text_hash string"), "id", "text", HashingEncoder(4))
    stored = first.withColumn("embedding", F.array(F.lit(9.0).cast("float")))
    now = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "new")], "id int, text string")
    got = {r.id: r.embedding for r in embed_changed(now, stored, "id", "text", HashingEncoder(4)).collect()}
    assert got[1] == [9.0] and len(got[2]) == 4 and len(got[3]) == 4


def test_query_text(one):
    assert [one(query_text(F.lit(t).cast("string"))) for t in ("  ", None, "x")] == ["therapist search", "therapist search", "x"]


def test_ingestion(spark, tmp_path):
    raw = spark.createDataFrame(
        [("s", "http://x/1", "JANE DOE", "CA", "  san jose, ", "A bio that is long enough", 80, 2000, 1),
         ("s", "http://x/1", "JANE ROE", "CA", "fresno", "Another bio that is long enough", 80, 2000, 2),
         ("s", "http://x/2", "Bob", "NV", None, "b", None, None, 3)],
        "source string, source_url string, name string, state string, city string, bio string, fee_min int, fee_max int, _seq int")
    empty = spark.createDataFrame([], T.PROFILE_SCHEMA)
    snapshot, rejected, vectors = ingest(raw, empty, encoder=HashingEncoder(8))
    row = snapshot.collect()
    assert len(row) == 1 and (row[0].name, row[0].city, row[0].fee_max) == ("Jane Roe", "Fresno", 80)
    assert len(row[0].embedding) == 8 and row[0].is_active and row[0].languages == []
    assert [r.reject_reason for r in rejected.collect()] == ["state"]
    counts = stage_counts(raw, raw.where("state = 'CA'"), vectors, "s").first()
    assert (counts.scraped, counts.cleaned, counts.embedded, counts.failed) == (3, 2, 1, 0)
    snapshot.write.parquet(str(tmp_path / "p"))
    again = T.read_profiles(spark, str(tmp_path / "p"))
    assert T.by_key(again, "source_url", "http://x/1").count() == 1 and again.columns == T.PROFILE_COLUMNS


def test_stages_are_counted_by_the_write(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def encoder(texts):
        calls.add(len(texts))
        if any("broken" in t for t in texts):
            raise ValueError("no")
        return [[1.0, 0.0]] * len(texts)

    rows = [(f"http://x/{i}", "Jane Doe", "CA" if i % 4 else "NV", "a broken bio that is long enough" if i == 7 else f"a bio that is long enough {i}") for i in range(200)]
    raw = spark.createDataFrame(rows, "source_url string, name string, state string, bio string").withColumns(
        {c: F.lit(None).cast(t) for c, t in (("fee_min", "int"), ("fee_max", "int"), ("city", "string"), ("languages", "array<string>"), ("credentials", "array<string>"))})
    path = str(tmp_path / "ingested")
    counts = write_ingested(raw.repartition(3), path, "s", text=F.col("bio"), encoder=encoder).first()
    stored = spark.read.parquet(path)
    assert (counts.scraped, counts.cleaned, counts.embedded + counts.failed) == (200, 150, 150)
    assert counts.stored == counts.embedded == stored.count() and 1 <= counts.failed <= 64
    assert calls.value == 150  # each text once


def test_stored_is_counted_from_the_snapshot(spark, tmp_path):
    raw = spark.createDataFrame([("a",), ("b",), ("c",)], "source_url string")
    vectors = raw.withColumn("embedding", F.when(F.col("source_url") == "c", F.array().cast("array<float>")).otherwise(F.array(F.lit(1.0).cast("float"))))
    spark.createDataFrame([("a",), ("old",)], "source_url string").write.parquet(str(tmp_path / "p"))  # b was lost
    counts = stage_counts(raw, raw, vectors, "s", spark.read.parquet(str(tmp_path / "p"))).first()
    assert (counts.embedded, counts.stored, counts.failed) == (2, 1, 1)


def test_union_and_cap(spark):
    a = spark.createDataFrame([(i, "c1" if i < 8 else "c2") for i in range(10)], "id int, city string")
    both = union_sources(a, spark.createDataFrame([(99,)], "id int"))
    assert both.count() == 11 and both.where("id = 99").first().city is None
    assert [r.id for r in cap_per_group(a, "city", "id", 3, 4).orderBy("id").collect()] == [0, 1, 2, 8]


def test_hashing_encoder_hashes_a_word_once(monkeypatch):
    from matchweave.operators import embed as M

    plain = np.zeros(16)
    words = ["aa", "b", "aa", "c" * 90, "B"] * 20
    for w in words:
        plain[int(M.hashlib.md5(w.lower().encode()).hexdigest()[:4], 16) % 16] += 1
    hashed, md5 = [], M.hashlib.md5
    monkeypatch.setattr(M.hashlib, "md5", lambda word: (hashed.append(word), md5(word))[1])
    encode = HashingEncoder(16)
    for _ in range(3):
        assert np.allclose(encode([" ".join(words)])[0], plain / np.linalg.norm(plain))
    assert len(hashed) == 2 + 3 and len(encode.cells) == 2  # long words are not kept
