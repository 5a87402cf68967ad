"""The command-line jobs over stored tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from matchweave import jobs, vocab
from matchweave.sources import tables as T
from tests.test_extract import HITS, PAGE, STRICT
from tests.test_search import make_profiles, make_queries

NOW = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(2)
    profiles, _ = make_profiles(spark, rng)
    profiles.withColumn("scraped_at", F.lit("2024-02-28").cast("timestamp")).write.parquet(str(root / "profiles"))
    make_queries(spark, rng, 8)[0].write.parquet(str(root / "queries"))
    spark.createDataFrame([(m, [rng.gauss(0, 1) for _ in range(4)]) for m in vocab.MODALITIES], "modality string, embedding array<double>"
                          ).write.parquet(str(root / "descriptions"))
    return root


def run(root, job, **options):
    args = [job]
    for k, v in options.items():
        args += [f"--{k.replace('_', '-')}"] + ([] if v is True else [str(root / v) if k not in ("as_of", "source", "variable", "dim", "name", "what") else str(v)])
    return jobs.main(args)


def test_search_without_descriptions_or_vectors(spark, stored):
    queries = spark.read.schema(T.QUERY_SCHEMA).parquet(str(stored / "queries"))
    queries.withColumn("embedding", F.lit(None).cast("array<float>")).write.parquet(str(stored / "texts_only"))
    profiles = T.read_profiles(spark, str(stored / "profiles"))
    wide = F.transform(F.sequence(F.lit(0), F.lit(383)), lambda i: (F.sin(i.cast("double") * F.col("id").cast("string").substr(2, 3).cast("int"))).cast("float"))
    profiles.withColumn("embedding", F.when(F.col("embedding").isNotNull(), wide)).write.parquet(str(stored / "wide"))
    assert run(stored, "search", queries="texts_only", profiles="wide", out="results2", log="searches2") == 0
    assert spark.read.parquet(str(stored / "results2")).where("rank = 1").count() > 0


def test_search_evaluate_and_history(spark, stored):
    assert run(stored, "search", queries="queries", profiles="profiles", descriptions="descriptions", out="results", log="searches") == 0
    results, log = spark.read.parquet(str(stored / "results")), spark.read.schema(T.SEARCH_SCHEMA).parquet(str(stored / "searches"))
    assert log.count() == 8 and results.where("rank = 1").count() == log.where(F.size("result_ids") > 0).count() > 0
    shown = log.where(F.size("result_ids") > 0).select(
        F.lit("f").alias("id"), F.col("id").alias("query_id"), F.element_at("result_ids", 1).alias("therapist_id"),
        F.lit(5).alias("rating"), F.lit(1).alias("rank_position"), F.lit("explicit").alias("event_type"),
        F.current_timestamp().alias("created_at"))
    T.append_feedback(shown, str(stored / "feedback"))
    assert run(stored, "evaluate", searches="searches", feedback="feedback", runs="runs", name="first") == 0
    assert run(stored, "evaluate", searches="searches", feedback="feedback", strict=True) == 0
    row = spark.read.parquet(str(stored / "runs")).first()
    assert row.run_name == "first" and row.ndcg_at_10 == 1 and row.mrr == 1
    assert run(stored, "history", runs="runs") == 0
    assert run(stored, "online", searches="searches", feedback="feedback", as_of="2030-01-01") == 0


def test_verify_exit_code(spark, stored, capsys):
    spark.createDataFrame([], T.FEEDBACK_SCHEMA).write.mode("ignore").parquet(str(stored / "none"))
    assert run(stored, "verify", profiles="profiles", feedback="none", as_of="2024-03-01", dim=4, fail_only=True) == 1
    assert "FAILED" in capsys.readouterr().out


def test_ingest_audit_and_corrections(spark, stored, capsys):
    (stored / "hits").mkdir()
    (stored / "hits" / "h.json").write_text("\n".join(HITS))
    (stored / "taxonomy.html").write_text(STRICT)
    assert run(stored, "ingest", source="directory", hits="hits", taxonomy="taxonomy.html", variable="cfg", out="p1") == 0
    assert "scraped" in capsys.readouterr().out
    spark.createDataFrame([("http://x/profile/pat-doe/", PAGE)], "url string, html string").write.parquet(str(stored / "pages"))
    assert run(stored, "ingest", source="pages", pages="pages", profiles="p1", out="p2") == 0
    rows = {r.source_id: r for r in T.read_profiles(spark, str(stored / "p2")).collect()}
    assert set(rows) == {"1", "2", "pat-doe"} and rows["1"].city == "Davis" and len(rows["pat-doe"].embedding) == 384
    spark.createDataFrame([("http://x/1", 404, "")], "source_url string, status int, text string").write.parquet(str(stored / "fetched"))
    assert run(stored, "audit", profiles="p2", fetched="fetched", out="p3") == 0
    assert T.read_profiles(spark, str(stored / "p3")).where("not is_active").count() == 1
    assert run(stored, "corrections", profiles="p3") == 0
    assert run(stored, "corrections", profiles="p3", out="p4") == 0
    assert T.read_profiles(spark, str(stored / "p4")).count() == 3


def test_enrich_fills_gaps_from_pages(spark, stored, capsys):
    rows = [("a", "dir", "http://x/a", None, []), ("b", "dir", "http://x/b", None, []), ("c", "other", "http://x/c", None, [])]
    people = spark.createDataFrame(rows, "id string, source string, source_url string, gender string, insurance_providers array<string>")
    people = people.withColumns({f.name: F.lit(True if f.name == "is_active" else None).cast(f.dataType) for f in T.PROFILE_SCHEMA if f.name not in people.columns})
    people.select(*T.PROFILE_COLUMNS).write.parquet(str(stored / "gaps"))
    page = ("<p><span>Gender</span><br>Woman</p><p><span>Race/Ethnicity</span><br>White</p>"
            '<script id="__NEXT_DATA__">{"props": {"pageProps": {"profile": {"slidingScale": true, "insuranceCompaniesList": ["Aetna Health"]}}}}</script>')
    spark.createDataFrame([("http://x/a", page), ("http://x/c", page)], "url string, html string").write.parquet(str(stored / "fetched_pages"))
    assert run(stored, "enrich", profiles="gaps", pages="fetched_pages", source="dir", out="e1") == 0
    got = {r.id: r for r in T.read_profiles(spark, str(stored / "e1")).collect()}
    assert (got["a"].gender, got["b"].gender, got["c"].gender) == ("Woman", None, None) and got["a"].ethnicity
    assert run(stored, "enrich", profiles="e1", pages="fetched_pages", source="dir", what="insurance", out="e2") == 0
    got = {r.id: r for r in T.read_profiles(spark, str(stored / "e2")).collect()}
    assert got["a"].insurance_providers == ["aetna"] and got["a"].sliding_scale and got["b"].insurance_providers == []
    assert "updated" in capsys.readouterr().out
