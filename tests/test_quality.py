"""Quality checks on small tables with known faults."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from matchweave.operators import quality as Q
from matchweave.sources.tables import PROFILE_SCHEMA

AS_OF = "2024-01-10 00:00:00"
DAY = dt.datetime(2024, 1, 9, tzinfo=dt.timezone.utc)


def table(spark, rows):
    good = {"name": "A", "state": "CA", "source_url": "http://x", "source": "s", "accepting_new_clients": True, "is_active": True,
            "fee_min": 80, "fee_max": 90, "bio": "long enough for the check", "profile_completeness": 1, "modalities": ["emdr"],
            "embedding": [1.0, 0.0], "scraped_at": DAY, "session_formats": ["both"], "insurance_providers": ["aetna"]}
    names = PROFILE_SCHEMA.fieldNames()
    data = []
    for i, over in enumerate(rows):
        row = good | {"id": f"p{i}", "source_url": f"http://x/{i}"} | over
        for c in ("rating", "profile_completeness"):
            row[c] = None if row.get(c) is None else __import__("decimal").Decimal(str(row[c]))
        data.append(tuple(row.get(c) for c in names))
    return spark.createDataFrame(data, PROFILE_SCHEMA)


def checks(spark, rows, feedback=("p0",), dim=2):
    fb = spark.createDataFrame([(f,) for f in feedback], "therapist_id string")
    out = Q.run_all(table(spark, rows), fb, F.lit(AS_OF).cast("timestamp"), dim=dim)
    return out, {r.name: r for r in out.collect()}


def test_clean_table_passes(spark):
    out, got = checks(spark, [{"source": s} for s in "abcab"])
    assert [n for n, r in got.items() if not r.passed] == []
    assert len(got) == 29 and got["totals_summary"].detail == "total=5, active=5, accepting=5, embedded=5"
    assert tuple(Q.verdict(out).first()) == (29, 29, 0, 0, "PASSED")
    assert sum(r.n for r in Q.report(out).collect()) == 29


@pytest.mark.parametrize("fault, check, severity", [
    ({"name": None}, "not_null_name", "FAIL"), ({"is_active": None}, "not_null_is_active", "FAIL"),
    ({"source_url": "http://x/0"}, "unique_source_url", "FAIL"), ({"fee_min": 91}, "fee_min_lte_fee_max", "FAIL"),
    ({"rating": 5.5}, "rating_range", "FAIL"), ({"modalities": ["magic"]}, "value_domains", "FAIL"),
    ({"bio": ""}, "bio_min_length", "FAIL"), ({"profile_completeness": 1.5}, "profile_completeness_range", "FAIL"),
    ({"fee_min": -1}, "no_negative_fees", "FAIL"), ({"fee_max": 1001}, "fees_not_excessive", "WARN"),
    ({"source_url": "ftp://x"}, "source_url_format", "FAIL"),
    ({"scraped_at": dt.datetime(2024, 1, 11, tzinfo=dt.timezone.utc)}, "no_future_timestamps", "WARN"),
    ({"state": "NV"}, "all_home_state", "FAIL"), ({"embedding": None}, "embedding_presence", "FAIL"),
    ({"embedding": [1.0]}, "embedding_dimensions", "FAIL"), ({"embedding": [0.001, 0.0]}, "no_zero_embeddings", "FAIL"),
    ({"modalities": []}, "active_have_modalities", "WARN"), ({"latitude": 45.0, "longitude": -120.0}, "coordinates_in_bounds", "WARN"),
])
def test_each_fault_is_found(spark, fault, check, severity):
    _, got = checks(spark, [{"source": "a"}, {"source": "b"}, {"source": "c"}, {"source": "a"}, fault])
    assert not got[check].passed and got[check].severity == severity


def test_distribution_checks(spark):
    _, got = checks(spark, [{"source": "a"}] * 9 + [{"source": "b", "embedding": None}], feedback=("p0", "gone", "gone"))
    assert not got["source_distribution"].passed and got["source_distribution"].severity == "WARN"
    assert not got["embedding_coverage_by_source"].passed
    assert got["no_orphaned_feedback"].detail == "2 orphan(s)"
    _, stale = checks(spark, [{"scraped_at": dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc), "profile_completeness": 0.5}])
    assert not stale["data_recency"].passed and stale["data_recency"].detail == "newest record is 9.0 day(s) old"
    assert not stale["avg_profile_completeness"].passed


def test_empty_table_is_skipped(spark):
    _, got = checks(spark, [], feedback=())
    assert got["embedding_presence"].passed and got["embedding_presence"].detail == "no records (skipped)"
    assert got["active_have_modalities"].detail == "no active records (skipped)"
    assert got["data_recency"].passed and got["top_cities"].detail == "no data"
    assert all(r.passed for r in got.values())


def test_single_table_checks_read_the_table_once(spark, tmp_path):
    table(spark, [{}]).write.parquet(str(tmp_path / "p"))
    df = Q.single_pass_checks(spark.read.parquet(str(tmp_path / "p")), F.lit(AS_OF).cast("timestamp"), dim=2)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1


def test_coverage(spark):
    got = Q.coverage(table(spark, [{"gender": "Woman"}, {}]), {"gender": F.col("gender").isNotNull()}).first()
    assert (got.total, got.has_gender, got.gender_pct) == (2, 1, 50.0)
