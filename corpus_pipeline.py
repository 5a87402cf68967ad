"""The corpus pipeline: each stage calls one operator of ``matchweave.llm`` on what the last one kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave.llm import cotraining, packing, pii, simhash, toxicity
from matchweave.llm.common import stored
from matchweave.llm.queries import prepare


#: How near fingerprints are found in ``drop_copies``.
NEAR = {"reach": 8, "bands": 5, "flip": True, "shard_rows": 2048}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather not toxic; the model is trained on the labelled ones of ``docs``."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model, score="__toxicity", offending="__offending")
    return scored.where("__toxicity < 0.5").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are rather of good quality."""
    model = cotraining.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotraining.score(docs, model, score="__quality", keep="__keep").where("__keep").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id.

    Fingerprints of 2-word shingles link at 8 bits: on a sample of 10,000 documents that takes in 0.89 of the pairs with a
    similarity of 0.8 in five-word shingles, and no pair under 0.3.  At so wide a reach nearly all fingerprints would visit
    nearly all shards of a tree, so they meet by the values of five bands: in one of them at most one bit differs.
    """
    return simhash.keep_one(docs, words=2, **NEAR)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the kind of each identifier in its place; n_chars follows the text."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, up to 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), memo_bytes=32 << 20)


STAGES = [("toxicity", drop_toxic), ("quality classifier", drop_poor), ("SimHash near-dedup", drop_copies),
          ("PII", hide_personal_data), ("packing", pack)]

#: The stages learn, hash and scan in ways SQL can't say; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what each returns is stored and read again, sequences by bucket."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = stored(docs, "pipeline-" + name.replace(" ", "-").lower(), *{"bucket"}.intersection(docs.columns if name == "packing" else ()))
    return docs
