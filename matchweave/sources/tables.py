"""Table schemas, scans and appends.

Profiles, searches, feedback and evaluation runs are plain parquet with declared schemas;
logs are partitioned by day so time filters prune directories.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
    "decimal(3.2)": T.DecimalType(3, 2), "decimal(5.4)": T.DecimalType(5, 4),
    "decimal(10.2)": T.DecimalType(10, 2),
}


def _schema(fields: str) -> T.StructType:
    """A schema from ``name type`` pairs; unlike a DDL string it needs no running session."""
    pairs = [field.split() for field in fields.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


PROFILE_SCHEMA = _schema(
    "id string, source string, source_url string, source_id string, name string, "
    "credentials array<string>, license_number string, years_experience int, gender string, "
    "ethnicity array<string>, modalities array<string>, specializations array<string>, "
    "populations_served array<string>, languages array<string>, city string, state string, "
    "zip_code string, county string, latitude double, longitude double, "
    "session_formats array<string>, insurance_providers array<string>, sliding_scale boolean, "
    "fee_min int, fee_max int, accepting_new_clients boolean, bio string, "
    "rating decimal(3.2), review_count int, profile_completeness decimal(3.2), "
    "embedding array<float>, scraped_at timestamp, last_updated timestamp, is_active boolean"
)

QUERY_SCHEMA = _schema(
    "query_id string, free_text string, concerns array<string>, embedding array<float>, "
    "city string, zip_code string, insurance string, session_format string, max_budget int, "
    "preferred_gender string, preferred_language string, preferred_ethnicity string, "
    "age_group string"
)

SEARCH_SCHEMA = _schema(
    "id string, session_id string, free_text string, extracted_intent string, "
    "filter_criteria string, result_ids array<string>, total_candidates int, "
    "filtered_count int, latency_ms decimal(10.2), llm_tokens int, cache_hit boolean, "
    "created_at timestamp"
)

FEEDBACK_SCHEMA = _schema(
    "id string, query_id string, therapist_id string, rating int, rank_position int, "
    "event_type string, booked boolean, feedback_text string, created_at timestamp"
)

EVAL_RUN_SCHEMA = _schema(
    "id string, run_name string, ndcg_at_10 decimal(5.4), mrr decimal(5.4), "
    "precision_at_5 decimal(5.4), num_queries int, config_snapshot string, "
    "created_at timestamp"
)

PROFILE_COLUMNS = PROFILE_SCHEMA.fieldNames()


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profile scan with the fixed column list; Spark prunes what a query does not use."""
    return spark.read.schema(PROFILE_SCHEMA).parquet(path).select(*PROFILE_COLUMNS)


def read_profiles_jdbc(spark: SparkSession, url: str, table: str = "therapists", **options) -> DataFrame:
    """Profile scan over JDBC; pass ``partitionColumn`` and bounds for a parallel read."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def by_key(df: DataFrame, key: str, value) -> DataFrame:
    """Point lookup; the equality reaches parquet and skips row groups by min/max."""
    return df.where(F.col(key) == F.lit(value))


def shared_root(spark: SparkSession) -> str | None:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the context's own, if any."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for ``name`` under the shared root."""
    root = shared_root(spark)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(root, "matchweave", f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so later steps do not recompute it.

    The written table survives lost executors and gives the optimizer real sizes.  Without a
    shared folder this is an error, as a frame computed again may number its rows differently.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def append_searches(df: DataFrame, path: str) -> None:
    """Append search log rows; struct-typed intent and criteria are stored as JSON."""
    for c in ("extracted_intent", "filter_criteria"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
        elif not isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, F.to_json(c))
    _append(df, SEARCH_SCHEMA, path)


def append_feedback(df: DataFrame, path: str) -> None:
    """Append feedback rows; the event type defaults to an explicit rating."""
    df = df.withColumn("event_type", F.coalesce(F.col("event_type"), F.lit("explicit")))
    _append(df, FEEDBACK_SCHEMA, path)


def append_eval_run(df: DataFrame, path: str) -> None:
    """Append evaluation runs."""
    typed = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVAL_RUN_SCHEMA])
    typed.write.mode("append").parquet(path)


def _append(df: DataFrame, schema: T.StructType, path: str) -> None:
    typed = df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    # dealt by day, so that a day gets few files whatever the number of tasks; a large day is split
    (typed.withColumn("created_date", F.to_date("created_at")).hint("rebalance", F.col("created_date"))
     .write.mode("append").partitionBy("created_date").parquet(path))


def newest(df: DataFrame, order: str, n: int = 20) -> DataFrame:
    """The newest ``n`` rows (a top-n report)."""
    return df.orderBy(F.col(order).desc()).limit(n)
