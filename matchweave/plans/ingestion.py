"""Ingestion: raw profiles to cleaned, embedded rows and the next profile snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from matchweave.operators.changes import upsert
from matchweave.operators.clean import clean_profiles, embedding_text
from matchweave.operators.embed import Encoder, embed, with_vectors
from matchweave.sources.tables import PROFILE_SCHEMA, materialize


def union_sources(*sources: DataFrame) -> DataFrame:
    """Rows of several sources in one schema; columns a source lacks are NULL."""
    out = sources[0]
    for more in sources[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def cap_per_group(df: DataFrame, group: str, order: str, per_group: int,
                  overall: int | None = None) -> DataFrame:
    """At most ``per_group`` rows of each group, and ``overall`` rows in all (an ingestion option)."""
    w = Window.partitionBy(group).orderBy(order)
    out = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_group).drop("_rn")
    return out if overall is None else out.orderBy(group, order).limit(overall)


def stage_counts(raw: DataFrame, clean: DataFrame, vectors: DataFrame, source: str, snapshot: DataFrame | None = None,
                 key: str = "source_url") -> DataFrame:
    """One row: scraped, cleaned, embedded, stored, failed.

    ``stored`` counts the rows of the written ``snapshot`` whose ``key`` was embedded; NULL without one.
    """
    embedded = vectors.agg(
        F.count(F.when(F.size("embedding") > 0, 1)).alias("embedded"),
        F.count(F.when(F.size("embedding") <= 0, 1)).alias("failed"))
    stored = F.lit(None).cast("long")
    if snapshot is not None:
        done = vectors.where(F.size("embedding") > 0).select(key)
        stored = snapshot.select(key).join(done, key, "left_semi").agg(F.count("*").alias("n")).scalar()
    return embedded.select(
        F.lit(source).alias("source"), raw.agg(F.count("*").alias("n")).scalar().alias("scraped"),
        clean.agg(F.count("*").alias("n")).scalar().alias("cleaned"), "embedded",
        stored.alias("stored"), "failed")


def write_ingested(raw: DataFrame, path: str, source: str, *, text: Column | None = None, encoder: Encoder | None = None,
                   home_state: str = "CA") -> DataFrame:
    """Clean and embed raw profiles and write those with a vector to ``path``; one row of the stages' counts.

    Every stage is counted by an observation while the one write runs, so the rows are made once.
    """
    scraped, cleaned, embedded, stored = (Observation(n) for n in ("scraped", "cleaned", "embedded", "stored"))
    every = F.count(F.lit(1)).alias("n")
    clean, _ = clean_profiles(raw.observe(scraped, every), home_state)
    has = F.size("embedding") > 0
    rows = with_vectors(clean.observe(cleaned, every).drop("embedding"), embedding_text() if text is None else text, encoder)
    rows = rows.observe(embedded, F.count(F.when(has, 1)).alias("n"), F.count(F.when(~has, 1)).alias("failed"))
    rows.where(has).drop("error").observe(stored, every).write.parquet(path)
    counts = (source, *(o.get["n"] for o in (scraped, cleaned, embedded, stored)), embedded.get["failed"])
    return raw.sparkSession.createDataFrame([counts], "source string, scraped long, cleaned long, embedded long, stored long, failed long")


def cleaned(raw: DataFrame, home_state: str = "CA") -> DataFrame:
    """The raw rows that ``ingest`` takes."""
    return clean_profiles(_complete(raw), home_state)[0]


def ingest(raw: DataFrame, base: DataFrame, *, encoder: Encoder | None = None, home_state: str = "CA",
           key: str = "source_url") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next snapshot, rejected rows, vectors) from raw profile rows.

    ``raw`` needs the profile columns it has and ``_seq``, the order in which versions of one
    profile were read.  A profile whose embedding failed is not stored.  Vectors are made once and written to the
    shared folder.
    """
    clean, rejected = clean_profiles(_complete(raw), home_state)
    texts = clean.select(key, "_seq", embedding_text().alias("_text"))
    latest = texts.groupBy(key).agg(F.max_by("_text", "_seq").alias("_text"))
    vectors = materialize(embed(latest, key, "_text", encoder), "vectors")
    ready = vectors.where(F.size("embedding") > 0).select(key, "embedding")
    rows = clean.drop("embedding").join(ready, key)
    return upsert(base, rows.select(*base.columns, "_seq"), key=key), rejected, vectors


def _complete(raw: DataFrame) -> DataFrame:
    """Add the profile columns a source does not have, with the stored defaults."""
    defaults = {
        "id": F.expr("uuid()"), "accepting_new_clients": F.lit(True), "is_active": F.lit(True),
        "sliding_scale": F.lit(False), "review_count": F.lit(0), "scraped_at": F.current_timestamp(),
        "last_updated": F.current_timestamp(),
    }
    out = raw
    for f in PROFILE_SCHEMA:
        if f.name in out.columns:
            out = out.withColumn(f.name, F.col(f.name).cast(f.dataType))
        else:
            value = defaults.get(f.name, F.lit(None))
            if f.dataType.typeName() == "array" and f.name != "embedding":
                value = F.array()
            out = out.withColumn(f.name, value.cast(f.dataType))
    return out
