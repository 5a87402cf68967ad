"""Command-line jobs over stored tables: ``python -m matchweave.jobs <job> ...``.

Tables are parquet folders with the schemas of ``matchweave.sources.tables``.  Jobs that
change profiles write the next snapshot to ``--out`` and never touch the one they read.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.operators import changes as C
from matchweave.operators import evaluate as E
from matchweave.operators import extract as H
from matchweave.operators import online as M
from matchweave.operators import quality as Q
from matchweave.operators.extract import page_profiles
from matchweave.plans import ingestion, search
from matchweave.sources import directory
from matchweave.sources import tables as T
from matchweave.sources.knowledge import Knowledge, read_knowledge


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def run_search(spark, a) -> int:
    """Rank every search and write the result rows, and the search log if asked for.

    Searches without a vector get that of their text, and modalities that of their description unless
    --descriptions has them; --vectors is a table (text_hash, embedding) of texts encoded before.
    """
    stored = spark.read.parquet(a.vectors) if a.vectors else None
    queries = T.materialize(search.ask(spark.read.schema(T.QUERY_SCHEMA).parquet(a.queries), stored=stored), "asked")
    described = spark.read.parquet(a.descriptions) if a.descriptions else T.materialize(search.description_vectors(spark, stored=stored), "described")
    profiles = T.read_profiles(spark, a.profiles)
    weights = read_knowledge(spark, a.knowledge) if a.knowledge else Knowledge().weights(spark)
    chosen, pairs = search.candidates(queries, profiles, home_state=a.state)
    ranked = search.rank_candidates(chosen, pairs, profiles, described, weights)
    ranked = T.materialize(ranked, "ranked")
    _write(search.results(ranked), a.out)
    if a.log:
        T.append_searches(search.search_log(chosen, ranked).withColumn("created_at", F.current_timestamp()), a.log)
    return 0


def run_ingest(spark, a) -> int:
    """Landed directory hits or pages to the next profile snapshot; prints the stage counts."""
    if a.hits:
        taxonomy = directory.parse_taxonomy(spark.read.text(a.taxonomy, wholetext=True), "value", a.variable)
        raw = directory.hits_to_profiles(directory.read_hits(spark, a.hits), taxonomy, a.source)
    else:
        raw = page_profiles(spark.read.parquet(a.pages), a.source)
    # Versions of one profile come in the order of a column of the input, else of their content.
    seq = F.struct(*[F.col(a.order)] if a.order in raw.columns else [], F.to_json(F.struct(*raw.columns)))
    raw = T.materialize(raw.withColumn("_seq", seq), "raw")
    base = (T.read_profiles(spark, a.profiles) if a.profiles
            else spark.createDataFrame([], T.PROFILE_SCHEMA))
    snapshot, rejected, vectors = ingestion.ingest(raw, base, home_state=a.state)
    _write(snapshot, a.out)
    counts = ingestion.stage_counts(raw, ingestion.cleaned(raw, a.state), vectors, a.source, T.read_profiles(spark, a.out))
    counts.show(truncate=False)
    rejected.groupBy("reject_reason").count().show()
    return 0


def run_enrich(spark, a) -> int:
    """Fill gaps of one source's profiles from their fetched pages (url, html): gender and ethnicity, or insurance."""
    profiles, pages = T.read_profiles(spark, a.profiles), spark.read.parquet(a.pages)
    if a.what == "gender":
        seen = pages.select(F.col("url").alias("source_url"), H.gender_and_ethnicity(F.col("html")).alias("_f"))
        found = seen.select("source_url", F.lit(True).alias("ok"), "_f.gender", "_f.ethnicity")
        after, outcomes = C.fill_missing(profiles, found, source=a.source, key="source_url")
    else:
        seen = pages.select(F.col("url").alias("source_url"), H.embedded_profile(F.col("html")).alias("_p")).where(F.col("_p").isNotNull())
        found = seen.select("source_url", H.providers_from_names(F.col("_p.insurers")).alias("insurance_providers"), F.col("_p.sliding").alias("sliding_scale"))
        after, outcomes = C.overwrite_insurance(profiles, found, source=a.source, key="source_url")
    _write(after, a.out)
    C.outcome_counts(outcomes).show()
    return 0


def run_audit(spark, a) -> int:
    """Apply fetched page states (source_url, status, text) to the profiles."""
    after, outcomes = C.audit(T.read_profiles(spark, a.profiles), spark.read.parquet(a.fetched))
    _write(after, a.out)
    C.outcome_counts(outcomes).show()
    return 0


def run_corrections(spark, a) -> int:
    """Show how many cities each correction changes; with --out also write the snapshot."""
    profiles = T.read_profiles(spark, a.profiles)
    C.preview_corrections(profiles, "city").orderBy("bad").show(50, truncate=False)
    if a.out:
        _write(profiles.withColumn("city", C.correct_value(F.col("city"))), a.out)
        C.remaining_dirty(T.read_profiles(spark, a.out), "city").show()
    return 0


def run_evaluate(spark, a) -> int:
    """Ranking quality from logged results and feedback; with --runs the run is appended."""
    searches = spark.read.schema(T.SEARCH_SCHEMA).parquet(a.searches)
    feedback = spark.read.schema(T.FEEDBACK_SCHEMA).parquet(a.feedback).withColumnRenamed("therapist_id", "item")
    lists = E.graded_lists(E.shown_rows(searches), feedback, strict=a.strict)
    per_query = T.materialize(E.metrics(lists), "metrics")
    E.summary(per_query).show(truncate=False)
    E.worst_first(per_query).show(truncate=False)
    if a.runs:
        T.append_eval_run(E.evaluation_run(per_query, a.name, F.current_timestamp()), a.runs)
    return 0


def run_history(spark, a) -> int:
    """The newest evaluation runs, and which of them fell behind the run before."""
    runs = spark.read.schema(T.EVAL_RUN_SCHEMA).parquet(a.runs)
    T.newest(E.regressions(runs), "created_at").drop("config_snapshot", "id").show(truncate=False)
    return 0


def run_online(spark, a) -> int:
    """Engagement metrics for the days before --as-of."""
    searches = M.recent(spark.read.schema(T.SEARCH_SCHEMA).parquet(a.searches), a.as_of, a.days)
    all_feedback = spark.read.schema(T.FEEDBACK_SCHEMA).parquet(a.feedback)
    feedback = M.recent(all_feedback, a.as_of, a.days)
    for report in (M.volume(searches), M.feedback_rate(searches, all_feedback), M.feedback_rates(feedback, searches),
                   M.reformulation(searches), M.position_bias(feedback), M.top_reformulating(searches)):
        report.show(truncate=False)
    return 0


def run_verify(spark, a) -> int:
    """All quality checks; the exit code is 1 if a FAIL check failed."""
    profiles = T.read_profiles(spark, a.profiles)
    feedback = spark.read.schema(T.FEEDBACK_SCHEMA).parquet(a.feedback)
    checks = T.materialize(Q.run_all(profiles, feedback, F.lit(a.as_of).cast("timestamp"), dim=a.dim,
                                     home_state=a.state), "checks")
    shown = checks.where(~F.col("passed")) if a.fail_only else checks
    shown.orderBy("category", "name").show(100, truncate=False)
    verdict = Q.verdict(checks).first()
    print(f"{verdict.checks} checks, {verdict.passes} passed, {verdict.warns} WARN, {verdict.fails} FAIL: {verdict.status}")
    return 1 if verdict.fails else 0


JOBS = {
    "search": (run_search, ["queries", "profiles", "out"], {"descriptions": None, "vectors": None, "knowledge": None, "log": None, "state": "CA"}),
    "ingest": (run_ingest, ["source", "out"], {"hits": None, "taxonomy": None, "variable": "taxonomy", "pages": None,
                                               "profiles": None, "state": "CA", "order": "fetched_at"}),
    "enrich": (run_enrich, ["profiles", "pages", "source", "out"], {"what": "gender"}),
    "audit": (run_audit, ["profiles", "fetched", "out"], {}),
    "corrections": (run_corrections, ["profiles"], {"out": None}),
    "evaluate": (run_evaluate, ["searches", "feedback"], {"runs": None, "name": "evaluation", "strict": False}),
    "history": (run_history, ["runs"], {}),
    "online": (run_online, ["searches", "feedback", "as-of"], {"days": 7}),
    "verify": (run_verify, ["profiles", "feedback", "as-of"], {"dim": 384, "state": "CA", "fail-only": False}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="matchweave.jobs", description=__doc__.splitlines()[0])
    jobs = out.add_subparsers(dest="job", required=True)
    for name, (fn, required, optional) in JOBS.items():
        job = jobs.add_parser(name, help=fn.__doc__)
        for option in required:
            job.add_argument(f"--{option}", required=True)
        for option, default in optional.items():
            if default is False:
                job.add_argument(f"--{option}", action="store_true")
            else:
                job.add_argument(f"--{option}", default=default, type=type(default) if default is not None else str)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName(f"matchweave-{args.job}").getOrCreate()
    return JOBS[args.job][0](spark, args)


if __name__ == "__main__":
    sys.exit(main())
