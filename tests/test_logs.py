"""Online metrics, exact percentiles, rate limit and result reuse against brute force."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.functions import hist
from matchweave.functions.hist import bucketed_lag, exact_percentile, histogram
from matchweave.operators import online as M
from matchweave.operators.traffic import rate_limit, result_reuse
from matchweave.sources import tables as T

DAY = dt.datetime(2024, 3, 1, tzinfo=dt.timezone.utc)


def requests(spark, rows):
    """rows of (key, ms)"""
    return spark.createDataFrame([(k, ms) for k, ms in rows], "k string, ms bigint").select(
        "k", F.timestamp_millis("ms").alias("ts"))


def brute_limit(rows, limit, window):
    out = {}
    for k in {k for k, _ in rows}:
        seen = []
        for ms in sorted(m for kk, m in rows if kk == k):
            seen = [s for s in seen if s > ms - window]
            ok = len(seen) < limit
            a, d = out.get((k, ms), (0, 0))
            out[(k, ms)] = (a + ok, d + (not ok))
            if ms not in seen:
                seen.append(ms)
    return out


@pytest.mark.parametrize("limit, window", [(30, 60_000), (4, 60_000), (5, 300_000)])
def test_rate_limit(spark, limit, window):
    rng = random.Random(limit)
    # One client owns most of the log; some requests share a millisecond.
    rows = [("hot", rng.randrange(0, 900_000)) for _ in range(400)] + [("cold", rng.randrange(0, 900_000)) for _ in range(40)]
    rows += rows[:50]
    got = {(r.k, r.ms): (r.allowed, r.denied) for r in rate_limit(
        requests(spark, rows), client="k", limit=limit, window_ms=window).collect()}
    assert got == brute_limit(rows, limit, window)


def test_rate_limit_edges(spark):
    rows = [("a", 1000 + i) for i in range(31)] + [("b", 0), ("b", 60_000), ("c", 5), ("c", 5)]
    got = {(r.k, r.ms): r for r in rate_limit(requests(spark, rows), client="k").collect()}
    assert got[("a", 1030)].denied == 1 and got[("a", 1029)].allowed == 1
    assert got[("b", 60_000)].prior == 0
    assert (got[("c", 5)].prior, got[("c", 5)].allowed) == (0, 2)
    with pytest.raises(ValueError):
        rate_limit(requests(spark, rows), client="k", window_ms=90_000)


def brute_reuse(rows, ttl):
    out = {}
    for k in {k for k, _ in rows}:
        expiry = None
        for ms in sorted(m for kk, m in rows if kk == k):
            miss = expiry is None or ms >= expiry
            if miss:
                expiry = ms + ttl
            m, h = out.get((k, ms), (0, 0))
            out[(k, ms)] = (m + miss, h + (not miss))
    return out


@pytest.mark.parametrize("stretch", [1, 2, 5])
def test_result_reuse(spark, stretch):
    rng = random.Random(stretch)
    rows = [("hot", rng.randrange(0, 200_000)) for _ in range(500)]
    rows += [(f"k{i % 7}", rng.randrange(0, 200_000)) for i in range(60)] + rows[:20]
    got = {(r.k, r.ms): (r.misses, r.hits) for r in result_reuse(
        requests(spark, rows), key="k", ttl_seconds=7, stretch_ttls=stretch).collect()}
    assert got == brute_reuse(rows, 7000)


@pytest.mark.parametrize("fan", [2, 3])
def test_result_reuse_composes_blocks(spark, fan):
    """One client with all requests and several levels of blocks, gaps of many stretches included."""
    rng = random.Random(fan)
    times = {rng.randrange(0, 300_000) for _ in range(400)} | {rng.randrange(900_000, 1_000_000) for _ in range(150)} | {2_000_000, 2_000_001}
    rows = [("only", t) for t in times]
    out = result_reuse(requests(spark, rows), key="k", ttl_seconds=7, stretch_ttls=1, fan=fan, bucket_rows=40)
    got = {(r.k, r.ms): (r.misses, r.hits) for r in out.collect()}
    assert got == brute_reuse(rows, 7000)
    assert result_reuse(requests(spark, rows).limit(0), key="k").count() == 0


def test_result_reuse_does_not_extend(spark):
    rows = [("a", 0), ("a", 3_000_000), ("a", 3_700_000)]
    got = {r.ms: (r.misses, r.hits) for r in result_reuse(requests(spark, rows), key="k").collect()}
    assert got == {0: (1, 0), 3_000_000: (0, 1), 3_700_000: (1, 0)}


def test_exact_percentile_narrows_in_several_scans(spark, monkeypatch):
    """Few parts a scan and many rows in each: the rank still comes out exactly, in four scans at most."""
    rng = random.Random(6)
    values = [rng.choice([1.0, 2.0, -0.0, 0.0, rng.random() * 100, -rng.expovariate(1), rng.random() * 1e-310, 1e300 * rng.random()]) for _ in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(7)
    taken = []
    collect = type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: taken.append(len(rows := collect(self))) or rows)
    for rows_a_scan in (1, 4, 16):
        monkeypatch.setattr(hist, "SELECT_BITS", 16)
        monkeypatch.setattr(hist, "FEW_ROWS", rows_a_scan)
        for p in (0.1, 0.5, 0.9, 0.99):
            taken.clear()
            row = exact_percentile(df, "v", p)
            assert 1 <= len(taken) <= 4 and max(taken) <= 1 << 17
            assert row.first().v == pytest.approx(np.quantile(values, p), rel=1e-12)
    ranks = sorted(values)
    for bits in (4, 7):
        monkeypatch.setattr(hist, "SELECT_BITS", bits)
        assert hist.select_ranks(df, "v", lambda n: [0, 17, n // 2, n - 1]) == (5000, [ranks[i] for i in (0, 17, 2500, 4999)])


def test_ordered_bits(spark):
    inf = float("inf")
    values = [-inf, -1.7976931348623157e308, -2.0, -1.0000000000000002, -1.0, -2.2250738585072014e-308, -5e-324, 0.0, 5e-324, 1e-310, 2.225073858507201e-308,
              2.2250738585072014e-308, 0.1, 0.5, 0.9999999999999999, 1.0, 1.0000000000000002, 2.0, 3.0, 4.0 - 4.5e-16, 4.0, 8.0, 1e22, 2.0 ** 1023, 1.7976931348623157e308, inf]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (-0.0,), (float("nan"),)], "v double")
    got = [r.b for r in df.select(hist.ordered_bits(F.col("v")).alias("b")).collect()]
    bits = got[:len(values)]
    assert bits == sorted(set(bits)) and [hist.from_ordered_bits(b) for b in bits] == values
    assert got[len(values):] == [None, 0, (1 << 63) - 1] and np.isnan(hist.from_ordered_bits(got[-1]))
    rng = random.Random(3)
    values = [rng.choice([-1, 1]) * rng.random() * 2.0 ** rng.randrange(-1070, 1020) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [hist.from_ordered_bits(r.b) for r in df.select(hist.ordered_bits(F.col("v")).alias("b")).collect()] == values
    odd = spark.createDataFrame([(v,) for v in [float("nan"), 1.0, None, -inf]], "v double")
    assert exact_percentile(odd, "v", 0.5).first().v == 1.0 and np.isnan(exact_percentile(odd, "v", 1.0).first().v)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 50 + [9.0], [float(x) for x in range(1000)],
    [random.Random(1).expovariate(1) for _ in range(777)], [0.0] * 600 + [float(x) for x in range(300)]])
def test_exact_percentile(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for p in (0.5, 0.99, 1.0, 0.0):
        row = exact_percentile(df, "v", p).first()
        assert row.v == pytest.approx(np.quantile(values, p)) and row.n == len(values)


def test_exact_percentile_of_nothing(spark):
    assert tuple(exact_percentile(spark.createDataFrame([], "v double"), "v", 0.99).first()) == (None, 0)


def test_bucketed_lag(spark):
    rng = random.Random(2)
    rows = [(i, rng.random()) for i in rng.sample(range(1000), 60)]
    out = bucketed_lag(spark.createDataFrame(rows, "t int, v double"), "t", F.floor(F.col("t") / 100), ["v"])
    got = {r.t: r.prev_v for r in out.collect()}
    ordered = sorted(rows)
    assert got == {t: (ordered[i - 1][1] if i else None) for i, (t, _) in enumerate(ordered)}


def test_histogram(spark):
    df = spark.createDataFrame([(1.0,), (5.0,), (5.1,), (100.0,), (None,)], "v double")
    assert {r.le: r.n for r in histogram(df, "v", [5, 10]).collect()} == {5.0: 2, 10.0: 3, None: 4}


def searches(spark, rows):
    return spark.createDataFrame(
        [(i, s, t, n, lat, hit, DAY + dt.timedelta(hours=i)) for i, s, t, n, lat, hit in rows],
        "id int, session_id string, free_text string, filtered_count int, latency_ms double, cache_hit boolean, created_at timestamp")


LOG = [(1, "a", "x", 0, 10.0, True), (2, "a", "y", 3, 0.0, False), (3, "b", "z", 3, 30.0, False),
       (4, None, "w", 3, 20.0, False), (5, "a", None, 1, 0.0, False)]


def test_volume_and_sessions(spark):
    s = searches(spark, LOG)
    v = M.volume(s).first()
    assert (v.total_searches, v.total_sessions, v.cache_hit_rate, v.avg_latency_ms, v.zero_result_rate) == (5, 2, 0.2, 20.0, 0.2)
    assert M.approximate_sessions(s).first()[0] == 2
    assert tuple(M.reformulation(s).first()) == (2.0, 1, 2)
    assert [tuple(r) for r in M.top_reformulating(s, preview=2).collect()] == [("a", 3, "x -> y")]
    assert M.session_queries(s).count() == 3


def test_rates(spark):
    s = searches(spark, LOG)
    f = spark.createDataFrame([(1, 5, "explicit", 1), (1, 1, "explicit", 2), (1, 1, "profile_view", 1), (9, 5, "explicit", None)],
                              "query_id int, rating int, event_type string, rank_position int")
    assert tuple(M.feedback_rate(s, f).first()) == (5, 1, 0.2)
    r = M.feedback_rates(f, s).first()
    assert (r.thumbs_up_rate, r.searches_with_view, r.profile_view_rate) == (pytest.approx(2 / 3), 1, 0.2)
    nothing = s.where("false")
    assert M.feedback_rate(nothing, f).first().feedback_rate is None
    assert M.feedback_rates(f, nothing).first().profile_view_rate is None
    assert [tuple(x) for x in M.position_bias(f).collect()] == [(1, 2, 0.5, 0.5), (2, 1, 0.0, 0.0)]


def test_window_and_alerts(spark):
    s = searches(spark, LOG)
    assert M.recent(s, "2024-03-08 02:30:00", 7).count() == 3
    a = M.alerts(s, F.col("filtered_count") == 0).first()
    assert (a.latency_alert, a.error_alert, a.cache_alert) == (False, True, True)
    assert M.slow_queries(s, 15.0).count() == 2


def test_costs(spark):
    use = spark.createDataFrame([("all-MiniLM-L6-v2", 10), ("other", 5), ("other", 5)], "model string, tokens int")
    assert {r.model: r.cost_usd for r in M.token_cost(use).collect()} == {"all-MiniLM-L6-v2": 0.0, "other": pytest.approx(1e-5)}


def test_log_appends(spark, tmp_path):
    s = spark.createDataFrame([("q", "s", "text", ["anxiety"], ["b", "a"], DAY)],
                              "id string, session_id string, free_text string, concerns array<string>, result_ids array<string>, created_at timestamp")
    path = str(tmp_path / "searches")
    T.append_searches(s.withColumn("extracted_intent", F.struct("concerns")), path)
    T.append_searches(s.withColumn("extracted_intent", F.lit("{}")), path)
    rows = spark.read.parquet(path)
    assert rows.count() == 2 and set(T.SEARCH_SCHEMA.fieldNames()) <= set(rows.columns)
    assert {r.extracted_intent for r in rows.collect()} == {'{"concerns":["anxiety"]}', "{}"}
    assert rows.first().result_ids == ["b", "a"] and str(rows.first().created_date) == "2024-03-01"
    f = spark.createDataFrame([("f", "q", "a", 5, None, DAY)],
                              "id string, query_id string, therapist_id string, rating int, event_type string, created_at timestamp")
    T.append_feedback(f, str(tmp_path / "feedback"))
    assert spark.read.parquet(str(tmp_path / "feedback")).first().event_type == "explicit"


def test_shared_folder_is_read_from_the_session(spark, monkeypatch):
    assert T.shared_dir(spark, "x").startswith(T.shared_root(spark))
    monkeypatch.setattr(T, "shared_root", lambda _: None)
    with pytest.raises(ValueError):
        T.materialize(spark.range(3), "x")
    with pytest.raises(ValueError):
        T.shared_dir(spark, "x")


def test_an_append_writes_few_files_a_day(spark, tmp_path):
    """Not one file for each task and day."""
    rows = spark.range(400, numPartitions=8).select(
        F.col("id").cast("string"), F.lit(None).cast("string").alias("event_type"), F.timestamp_seconds(F.col("id") % 5 * 86400).alias("created_at"))
    T.append_feedback(rows, str(tmp_path / "feedback"))
    back = spark.read.parquet(str(tmp_path / "feedback"))
    assert back.count() == 400 and len(back.inputFiles()) == 5
