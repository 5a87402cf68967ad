"""Token ids of many texts, each distinct word encoded once per batch.

The byte-level pre-token pattern never joins the two sides of a single space that stands between
characters that are no white space, and puts that space at the head of the right side.  So a text
falls into chunks there, and equal chunks have equal ids.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = r"\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: RE2: a space next to more white space, where the text must not be cut.
_WIDE = f" [{_SPACE}]|[{_SPACE}] "
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Bytes of a dictionary's entry, about.
_ENTRY = 100


class Memo:
    """Bytes by string, for the strings used lately: two generations of at most ``limit`` bytes each.

    Strings of more than ``longest`` characters are not remembered: they hardly ever come again.
    """

    def __init__(self, limit: int, longest: int = 256):
        self.limit, self.longest, self.held, self.young, self.old = limit, longest, 0, {}, {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        out, old = list(map(self.young.get, keys)), self.old
        for i, value in enumerate(out):
            if value is None and (value := old.get(keys[i])) is not None:
                out[i] = value
                self.put(keys[i], value)
        return out

    def put(self, key: str, value: bytes) -> None:
        if len(key) > self.longest:
            return
        self.held += sys.getsizeof(key) + sys.getsizeof(value) + _ENTRY
        if self.held > self.limit:
            self.old, self.young, self.held = self.young, {}, 0
        self.young[key] = value


def encode(texts: pa.Array, encode_chunks: Callable[[list[str]], list[bytes]]) -> list[np.ndarray]:
    """Ids (uint32) of each text; ``encode_chunks`` gives those of chunks as little-endian bytes."""
    texts = pc.fill_null(texts, "")
    wide = pc.match_substring_regex(texts, _WIDE)
    out: list = [None] * len(texts)
    for mask, split in ((pc.invert(wide), lambda t: pc.split_pattern(t, " ")),
                        (wide, lambda t: pa.array([_CUT.split(x) for x in t.to_pylist()], pa.list_(pa.string())))):
        rows = np.flatnonzero(mask.to_numpy(zero_copy_only=False))
        if len(rows):
            for row, ids in zip(rows, _encode_lists(split(texts.filter(mask)), encode_chunks)):
                out[row] = ids
    return out


def _encode_lists(lists: pa.ListArray, encode_chunks) -> list[np.ndarray]:
    """Ids of texts given as lists of chunks, all but the first of a text without their leading space."""
    offsets = lists.offsets.to_numpy()
    chunks = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = chunks.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    spaced = [" " + c for c in coded.dictionary.to_pylist()]
    first = chunks.take(pa.array(offsets[:-1])).dictionary_encode()
    codes[offsets[:-1]] = len(spaced) + first.indices.to_numpy(zero_copy_only=False)
    encoded = encode_chunks(spaced + first.dictionary.to_pylist())
    flat = np.frombuffer(b"".join(encoded), "<u4")
    lengths = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
    starts = np.cumsum(lengths) - lengths
    each = lengths[codes]
    ends = np.cumsum(each)
    ids = flat[np.repeat(starts[codes] - (ends - each), each) + np.arange(ends[-1])]
    cuts = np.concatenate([[0], ends])[offsets]
    return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
