"""Sequences of power-of-two lengths: the binary decomposition of each document's token count."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm import chunks
from matchweave.llm.common import bounded, numbered, stored

#: Bytes of chunks that a worker remembers in each of two generations.
MEMO_BYTES = 96 << 20


class Encoder:
    """Ids of texts by the ``tokenizers`` library and one of its files, without adding special tokens.

    A special token's string inside a text has the token's id, as the library gives it.  If the file splits text by the
    byte-level pattern, which never joins the two sides of a single space, texts are cut there and equal chunks encoded once.
    """

    def __init__(self, described: str, memo_bytes: int = MEMO_BYTES):
        self.described, self.memo_bytes = described, memo_bytes
        self._ready()

    def __getstate__(self):
        return {"described": self.described, "memo_bytes": self.memo_bytes}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self._library, self._memo = tokenizers.Tokenizer.from_str(self.described), chunks.Memo(self.memo_bytes)
        self._library.no_truncation()
        self._library.no_padding()
        file = json.loads(self.described)
        split, flags = file["pre_tokenizer"] or {}, ("single_word", "lstrip", "rstrip", "normalized")
        plain = all(not any(t[f] for f in flags) and len(t["content"].split()) == 1 for t in file["added_tokens"])
        self.by_chunks = plain and file["normalizer"] is None and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex")) == ("ByteLevel", False, True)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_chunks(self, texts: list[str]) -> list[bytes]:
        out = self._memo.find(texts)
        missing = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(missing, self._encode([texts[i] for i in missing])):
            out[i] = ids
            self._memo.put(texts[i], ids)
        return out

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null is empty."""
        if self.by_chunks:
            return chunks.encode(texts, self._encode_chunks)
        return [np.frombuffer(x, "<u4") for x in self._encode(pc.fill_null(texts, "").to_pylist())]


def pieces_of(tokens: int, longest: int) -> list[int]:
    """Lengths that add up to ``tokens``: as many of ``longest`` as go, then the powers of two of the rest."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("ids", T.BinaryType())])


def pack(df: DataFrame, path: str, longest: int = 2048, end_id: int = 1, doc_id: str = "doc_id", text: str = "text",
         memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """One row per sequence: doc_id, start, length, doc_tokens, bucket, ids, sequence_id, offset.

    A document is the ids of its text by the ``tokenizers`` file ``path`` and then ``end_id``, so a null or empty text has one id.
    It is cut into pieces of ``longest`` (a power of two) and the powers of two of the remainder, longest
    first; every piece is a sequence of its own, without padding and from one document only.
    ``bucket`` is the base-2 logarithm of the length: a reader that fills a batch from one bucket needs
    no padding either (``write_buckets``).  ``ids`` holds unsigned 32-bit little-endian integers.  ``sequence_id`` is
    unique, not gapless: ``number`` makes it so.  Repeated rows are packed again; a null doc_id stays null.
    A worker remembers the ids of at most twice ``memo_bytes`` of chunks.
    No row is shuffled: documents of any length and sources of any share stay where they are read.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("longest is no power of two")
    with open(path, encoding="utf-8") as f:
        encoder = df.sparkSession.sparkContext.broadcast(Encoder(f.read(), memo_bytes))

    def run(batches):
        for part in bounded(batches, text):
            counts, starts, lengths, totals, ids = [], [], [], [], []
            for words in encoder.value.encode(part.column(text)):
                own = np.append(words, np.array([end_id], "<u4")).astype("<u4")
                cuts = pieces_of(len(own), longest)
                counts.append(len(cuts))
                start = 0
                for length in cuts:
                    starts.append(start)
                    ids.append(own[start:start + length].tobytes())
                    start += length
                lengths += cuts
                totals += [start] * len(cuts)
            rows = pa.array(np.repeat(np.arange(len(counts)), counts))
            buckets = [n.bit_length() - 1 for n in lengths]
            yield pa.RecordBatch.from_arrays(
                [pc.take(part.column(doc_id), rows), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()),
                 pa.array(totals, pa.int64()), pa.array(buckets, pa.int32()), pa.array(ids, pa.binary())], names=PIECES.names)

    pieces = df.select(F.col(doc_id).cast("long").alias(doc_id), text).mapInArrow(run, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def number(pieces: DataFrame) -> DataFrame:
    """``pieces`` with a gapless ``sequence_id``: bucket by bucket, in each by doc_id (a null one first) and start.

    It does not depend on how the rows lie.  Rows are stored and sorted, so give them without ``ids``.
    """
    rows = stored(numbered(pieces.drop("sequence_id"), "bucket", ["doc_id", "start"]), "packing-numbers")
    sizes = rows.groupBy("bucket").agg(F.first("total").alias("size"))
    before = F.sum("size").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # a row for each length
    first = sizes.select("bucket", F.coalesce(before, F.lit(0)).alias("first"))
    return rows.join(F.broadcast(first), "bucket").withColumn("sequence_id", F.col("first") + F.col("n")).drop("first", "n", "total")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The sequences as a table with one folder for each length."""
    pieces.write.partitionBy("bucket").parquet(path)
