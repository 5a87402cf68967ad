"""Registered queries against their SQL, and the pipeline's stages."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from matchweave.llm import pii, queries, simhash
from matchweave.llm.common import stored

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    from verify import compare, connect
    ok, note = compare(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.SQL[name])
    assert ok, note


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    before, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, FOLDER), "test-stage")
        seen.append((name, before, after))
        if name != "packing":
            assert after.columns == docs.columns
        before = after
    by = {name: (b, a) for name, b, a in seen}
    assert len(by) == 5
    for name in ("toxicity", "quality classifier"):
        b, a = by[name]
        assert 0.75 * b.count() < a.count() < b.count() and a.join(b, "doc_id", "left_anti").count() == 0
    b, a = by["SimHash near-dedup"]
    least = {}
    for r in simhash.near_duplicates(b, reach=8, words=2).collect():
        least[r.component_id] = min(r.doc_id, least.get(r.component_id, r.doc_id))
    assert sorted(r.doc_id for r in a.select("doc_id").collect()) == sorted(least.values())
    b, a = by["PII"]
    assert a.count() == b.count()
    for r in a.collect():
        assert r.n_chars == len(r.text) and (r.text == texts[r.doc_id]) == (not pii._spans(texts[r.doc_id]))
    b, a = by["packing"]
    totals = a.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all"))
    assert totals.where("n <> all").count() == 0 and totals.count() == b.count()


def test_stages_keep_columns_with_clashing_names(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("score", "keep", "offending", "fingerprint", "spans", "who", "digest")})
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, more, FOLDER)
        assert after.columns == more.columns, name
        after = stored(after, "test-clash")
        for c in ("score", "keep", "offending", "fingerprint", "spans", "who", "digest"):
            assert after.where(F.col(c) != F.concat(F.lit(c), F.col("doc_id").cast("string"))).count() == 0, (name, c)


CONTRACT = {
    1: "page_id payload_bytes payload_digest record_type refers_to", 2: "doc_id score keep",
    3: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    4: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 5: "doc_id n_tokens ids_sha256 decoded_sha256",
    6: "vec_id n_links component_id kept", 7: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    8: "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars", 9: "doc_id fingerprint component_id",
    10: "doc_id held_out score predicted", 11: "doc_id n_bytes n_removed n_spans kept_sha256",
    12: "doc_id leaf subroot root proof_sha256 folded_root verified", 13: "word form root n n_near form_n"}


@pytest.fixture(scope="module")
def results(spark):
    """The rows of the registered queries without SQL, by number."""
    return {int(n[2:].split("_")[0]): q(spark, FOLDER).collect() for n, q in queries.QUERIES.items() if n not in queries.SQL}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def test_queries_return_the_contracted_columns(spark, results):
    for name, query in queries.QUERIES.items():
        n = int(name[2:].split("_")[0])
        names = results[n][0].__fields__ if n in results else query(spark, FOLDER).columns
        assert set(CONTRACT[n].split()) <= set(names), name


def test_results_against_plain_python(results, texts):
    """What each query without SQL returns, from the texts in plain Python."""
    from tests.llm import plain_queries as plain

    for n in (2, 3, 4, 5, 9, 10):
        assert sorted(r.doc_id for r in results[n]) == sorted(texts)
    plain.media(results[3], texts)
    plain.spans(results[4], texts)
    plain.tokens(results[5], texts)
    plain.packed(results[7], texts)
    plain.near(results[9], texts)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == plain.held_out(r.doc_id) for r in results[10])
    assert all(r.keep == (r.score >= 0.5) for r in results[2])


def test_vectors_against_all_pairs(spark, results):
    from tests.llm import plain_queries as plain
    plain.vectors(results[6], spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect())


def test_keep_one_of_repeated_rows(spark):
    rows = [(2, "same words in this text here", "a"), (1, "same words in this text here", "b"), (1, "same words in this text here", "b"),
            (None, "same words in this text here", "c"), (None, None, "d"), (5, "", "e"), (6, "another text of its own kind", "f"), (None, "nobody names this one", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = simhash.keep_one(df).collect()
    assert sorted(((r.doc_id, r.fingerprint) for r in got), key=str) == sorted([(1, "b"), (5, "e"), (6, "f"), (None, "g")], key=str)
    assert got[0].__fields__ == df.columns and simhash.keep_one(df.limit(0)).count() == 0
