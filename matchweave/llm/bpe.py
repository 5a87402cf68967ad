"""Byte-level BPE: whole pre-tokens through a minimal perfect hash, all others merged with a heap."""

from __future__ import annotations

import base64
from array import array
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchweave.llm import chunks
from matchweave.llm.common import append
from matchweave.llm.perfect_hash import PerfectHash, hashes

#: Bytes that a worker remembers in each of two generations, of chunks and of words.
MEMO_BYTES = 32 << 20


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a file of lines "base64 rank"; ranks must be 0..n-1."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    if not all(tokens):
        raise ValueError("ranks are not 0..n-1")
    return tokens


class Codec:
    """Encoder and decoder for one vocabulary; built once by the driver and sent to the workers."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        at = self.hash.slots(hashes(tokens))
        self.id_at = np.empty(len(tokens), np.int64)
        self.id_at[at] = np.arange(len(tokens))
        self._ready()

    def __getstate__(self):
        return {k: self.__dict__[k] for k in ("tokens", "pattern", "hash", "id_at")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._ready()

    def _ready(self) -> None:
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.pair = [[self.rank.get(bytes((a, b))) for b in range(256)] for a in range(256)]
        self.split = regex.compile(self.pattern).findall
        self.memo, self.words = chunks.Memo(MEMO_BYTES), chunks.Memo(MEMO_BYTES)

    def whole(self, pieces: list[bytes]) -> np.ndarray:
        """First tier: the id of each piece that is a token, else -1."""
        ids = self.id_at[self.hash.slots(hashes(pieces))]
        tokens = self.tokens
        same = np.fromiter((tokens[i] == p for i, p in zip(ids.tolist(), pieces)), bool, len(pieces))
        return np.where(same, ids, -1)

    def merge(self, piece: bytes) -> list[int]:
        """Second tier: merge the pair of least rank, the leftmost first, over linked bytes.

        Part i starts at byte i and ends at ``end[i]``; ``before`` is the start of the part to its
        left.  A heap entry is stale if its parts have changed since.
        """
        rank, n = self.rank, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = self.pair
        heap = [(r, i, i + 2) for i, (a, b) in enumerate(zip(piece, piece[1:])) if (r := pair[a][b]) is not None]
        heapify(heap)
        while heap:
            _, left, stop = heappop(heap)
            middle = end[left]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue
            end[left], end[middle] = stop, -1
            if stop < n:
                before[stop] = left
                if (r := rank.get(piece[left:end[stop]])) is not None:
                    heappush(heap, (r, left, end[stop]))
            if left and (r := rank.get(piece[before[left]:stop])) is not None:
                heappush(heap, (r, before[left], stop))
        ids, start = [], 0
        while start < n:
            ids.append(rank[piece[start:end[start]]])
            start = end[start]
        return ids

    def encode_chunks(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = self.memo.find(texts)
        missing = [i for i, x in enumerate(out) if x is None]
        split = [self.split(texts[i]) for i in missing]
        pieces = list({p for found in split for p in found})
        found = dict(zip(pieces, self.words.find(pieces)))
        new = [p for p, x in found.items() if x is None]
        encoded = [p.encode() for p in new]
        for piece, data, one in zip(new, encoded, self.whole(encoded).tolist()):
            found[piece] = array("I", [one] if one >= 0 else self.merge(data)).tobytes()
            self.words.put(piece, found[piece])
        for i, parts in zip(missing, split):
            out[i] = b"".join([found[p] for p in parts])
            self.memo.put(texts[i], out[i])
        return out

    def decode(self, ids) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids])


def encode_documents(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit) and ``n_tokens`` of each whole text.

    Each match of ``pattern`` is encoded separately, without special tokens.  Null and empty texts
    have no ids; equal texts have equal ids; a long text is held whole by one task, nothing else is.
    """
    codec = df.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))

    def compute(batch):
        ids = chunks.encode(batch.column(text), codec.value.encode_chunks)
        return [pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(list(map(len, ids)), pa.int64())]

    return append(df, text, [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())], compute)


def decode_documents(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the bytes of the ids in column ``ids``; null ids decode to nothing."""
    tokens = df.sparkSession.sparkContext.broadcast(read_ranks(path))

    def compute(batch):
        table = tokens.value
        return [pa.array([b"".join([table[i] for i in np.frombuffer(x or b"", "<u4").tolist()])
                          for x in batch.column(ids).to_pylist()], pa.binary())]

    return append(df, ids, [T.StructField("decoded", T.BinaryType())], compute)


