"""Concern knowledge: which modalities help with which concern, and how strongly.

The table is a small configuration file, so it is read once into a ``Knowledge`` value whose
size is checked; DataFrame views of it are offered for joins and catalogue queries.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import check_literal_size


@dataclass(frozen=True)
class Knowledge:
    concerns: dict[str, dict[str, float]] = field(default_factory=lambda: vocab.KNOWLEDGE)
    aliases: dict[str, str] = field(default_factory=lambda: vocab.ALIASES)

    def __post_init__(self):
        check_literal_size(self.concerns, "concern table")
        check_literal_size(self.aliases, "alias table")

    @classmethod
    def from_json(cls, text: str) -> "Knowledge":
        """Parse the file format: concern keys, ``_aliases``, and other ``_`` keys as metadata."""
        raw = json.loads(text)
        concerns = {k: v for k, v in raw.items() if not k.startswith("_")}
        return cls(concerns, raw.get("_aliases", {}))

    def weights(self, spark: SparkSession) -> DataFrame:
        """(concern, ord, modality, mod_ord, strength)"""
        rows = [(c, i, m, j, float(s)) for i, (c, ms) in enumerate(self.concerns.items())
                for j, (m, s) in enumerate(ms.items())]
        return spark.createDataFrame(
            rows, "concern string, ord int, modality string, mod_ord int, strength double")


def read_knowledge(spark: SparkSession, path: str) -> DataFrame:
    """The same (concern, ord, modality, mod_ord, strength) rows read by Spark from JSON."""
    raw = spark.read.text(path, wholetext=True)
    # A MAP keeps the file's key order, which partial concern matches depend on.
    top = raw.select(F.from_json("value", "map<string,string>").alias("m"))
    concern = F.filter(F.map_entries("m"), lambda e: ~e["key"].startswith("_"))
    return (top.select(F.posexplode(concern).alias("ord", "c"))
            .select("ord", F.col("c.key").alias("concern"),
                    F.map_entries(F.from_json("c.value", "map<string,double>")).alias("ms"))
            .select("concern", "ord", F.posexplode("ms").alias("mod_ord", "e"))
            .select("concern", "ord", F.col("e.key").alias("modality"), "mod_ord",
                    F.col("e.value").alias("strength")))


def concern_catalogue(weights: DataFrame) -> DataFrame:
    """All known concern keys."""
    return weights.select("concern").distinct()
