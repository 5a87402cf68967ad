"""Batch embedding of profile texts with a pluggable encoder."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchweave import vocab
from matchweave.functions.text import strip
from matchweave.session import ship

Encoder = Callable[[Sequence[str]], Sequence[Sequence[float]]]
BATCH = 64
#: Words whose cells an encoder keeps, and how long they may be.
WORDS_HELD, WORD_CHARS = 1 << 16, 32
EMPTY_QUERY = "therapist search"


class HashingEncoder:
    """Deterministic stand-in for a model: unit vectors of hashed, lower-cased words."""

    def __init__(self, dim: int = vocab.EMBEDDING_DIM):
        self.dim = dim
        self.cells: dict[str, int] = {}  # of words met, a bounded number

    def _cell(self, word: str) -> int:
        cell = int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % self.dim
        if len(word) <= WORD_CHARS:
            if len(self.cells) >= WORDS_HELD:
                self.cells.clear()
            self.cells[word] = cell
        return cell

    def __call__(self, texts: Sequence[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for row, text in enumerate(texts):
            for word, n in Counter(text.lower().split()).items():
                cell = self.cells.get(word)
                out[row, self._cell(word) if cell is None else cell] += n
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1.0, norms)).tolist()


def query_text(text):
    """Text a search is embedded by; an empty one gets a fixed phrase."""
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", F.lit(EMPTY_QUERY)).otherwise(text)


def embed(df: DataFrame, key: str, text: str, encoder: Encoder | None = None,
          batch: int = BATCH) -> DataFrame:
    """(key, embedding, error): vectors of a text column; a failed batch gets empty vectors."""
    ship()
    encode = encoder or HashingEncoder()
    schema = (f"{key} {df.schema[key].dataType.simpleString()}, embedding array<float>, error string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at:at + batch]
                try:
                    vectors, error = list(encode(part[text].tolist())), None
                except Exception as exc:  # one bad batch must not lose the others
                    vectors, error = [[] for _ in range(len(part))], str(exc)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors,
                                    "error": [error] * len(part)})

    return df.select(key, text).mapInPandas(run, schema)


def with_vectors(df: DataFrame, text: Column, encoder: Encoder | None = None, batch: int = BATCH) -> DataFrame:
    """``df`` with ``embedding`` and ``error`` of a text, in one pass; only the texts leave the JVM.

    The function counts as not deterministic, so that a filter on its result does not run it once more.
    """
    ship()
    encode = encoder or HashingEncoder()

    @F.pandas_udf("embedding array<float>, error string")
    def vectors(texts: pd.Series) -> pd.DataFrame:
        out, errors = [], []
        for at in range(0, len(texts), batch):
            part = texts.iloc[at:at + batch].fillna("").tolist()
            try:
                found, error = list(encode(part)), None
            except Exception as exc:  # one bad batch must not lose the others
                found, error = [[] for _ in part], str(exc)
            out += found
            errors += [error] * len(part)
        return pd.DataFrame({"embedding": out, "error": errors})

    return df.withColumn("_vectors", vectors.asNondeterministic()(text)).withColumns({
        "embedding": F.col("_vectors.embedding"), "error": F.col("_vectors.error")}).drop("_vectors")


def text_vectors(texts: DataFrame, text: str = "text", *, stored: DataFrame | None = None, encoder: Encoder | None = None) -> DataFrame:
    """(text_hash, embedding) of each distinct text: those of ``stored`` (the same columns), and new ones for the rest.

    The hash is the text's sha256; a text that cannot be encoded has an empty vector and is not to be stored.
    """
    wanted = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("text_hash"), F.col(text).alias("text"))
    wanted = wanted.groupBy("text_hash").agg(F.first("text").alias("text"))
    kept = None
    if stored is not None:
        kept = stored.select("text_hash", F.col("embedding").cast("array<float>").alias("embedding")).dropDuplicates(["text_hash"])
        kept = kept.join(wanted.select("text_hash"), "text_hash", "left_semi")
        wanted = wanted.join(stored.select("text_hash"), "text_hash", "left_anti")
    new = with_vectors(wanted, F.col("text"), encoder).select("text_hash", "embedding")
    return new if kept is None else kept.unionByName(new)


def embed_changed(df: DataFrame, previous: DataFrame, key: str, text: str,
                  encoder: Encoder | None = None) -> DataFrame:
    """(key, embedding, text_hash): like ``embed``, reusing vectors of texts that did not change.

    ``previous`` holds (key, embedding, text_hash) of the last run, one row per key.
    """
    hashed = df.select(key, text, F.sha2(F.col(text), 256).alias("text_hash"))
    old = previous.select(key, "text_hash", F.col("embedding").alias("_old"))
    known = hashed.join(old, [key, "text_hash"], "left")
    fresh = embed(known.where(F.col("_old").isNull()), key, text, encoder).select(key, "embedding")
    kept = known.where(F.col("_old").isNotNull()).select(key, "text_hash", F.col("_old").alias("embedding"))
    new = known.where(F.col("_old").isNull()).select(key, "text_hash").join(fresh, key)
    return kept.select(key, "embedding", "text_hash").unionByName(new.select(key, "embedding", "text_hash"))
