"""Spelling variants: words one edit apart, found by dense comparison of tiles of the vocabulary.

Two words differ by one edit if their common prefix and common suffix together reach the longer
length less one.  So one of the two reaches half of that, and the words meet in the cell of their first
or of their last letters.  Cells are compared as matrices of code points, in blocks of bounded size.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import bounded, stored, texts_of

_RUN = re.compile(rb"[a-z\xc0-\xff]+")
#: Distinct words, and text bytes, that a worker counts before it hands its counts on.
COUNTED_WORDS, COUNTED_BYTES = 300_000, 64 << 20
#: Entries of the matrix that is compared at a time, and code points of the words on one of its sides.
ENTRIES, LETTERS = 1 << 18, 1 << 22


def runs_of(text: str) -> Counter:
    """How often each run of letters occurs, as Latin-1 bytes with A-Z in lower case; the letters are A-Z, a-z and U+00C0 to U+00FF."""
    return Counter(_RUN.findall(text.encode("latin-1", "replace").lower()))


def slipped(prefix: int, run: bytes, every: int) -> bytes:
    """``run`` without one letter, for one in ``every`` of them by the crc32 that ``prefix`` begins."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix)
    return run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]


def vocabulary(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least_length: int = 6, least_n: int = 5,
               every: int = 199) -> DataFrame:
    """(word, n) of the words of at least ``least_length`` letters and ``least_n`` occurrences in all texts.

    Each task counts its words before they are shuffled.  In a document, a run whose crc32 (of the id, a
    colon and the run) is divisible by ``every`` loses the letter that it points at.  A null text has no
    words, a null id is written as nothing; a repeated row counts again.
    """
    def rows(total):
        words = [w.decode("latin-1") for w in total]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    def run(batches):
        total, read = Counter(), 0
        for part in bounded(batches, "text"):
            for who, words in zip(part.column("who").to_pylist(), texts_of(part, "text")):
                prefix = zlib.crc32(f"{who or ''}:".encode())
                for word, n in runs_of(words).items():
                    if len(word) >= least_length and len(word := slipped(prefix, word, every)) >= least_length:
                        total[word] += n
            read += part.nbytes
            if len(total) > COUNTED_WORDS or read > COUNTED_BYTES:
                yield rows(total)
                total, read = Counter(), 0
        yield rows(total)

    counted = df.select(F.col(doc_id).cast("string").alias("who"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_n)


def _letters(words: list[str], width: int, right: bool) -> np.ndarray:
    """A row of code points for each word, padded with zeros to ``width`` behind or, if ``right``, in front."""
    text = "".join([w.rjust(width, "\0") if right else w.ljust(width, "\0") for w in words])
    codes = np.frombuffer(text.encode("latin-1"), np.uint8) if text.isascii() or max(text) <= "\xff" else np.frombuffer(text.encode("utf-32-le"), "<u4")
    return codes.reshape(len(words), width)


def _common(a: np.ndarray, b: np.ndarray, columns) -> np.ndarray:
    """How many of ``columns``, from the first on, are the same in each row of ``a`` and of ``b``."""
    alive = np.ones((len(a), len(b)), bool)
    n = np.zeros((len(a), len(b)), np.int32)
    for c in columns:
        alive &= a[:, c, None] == b[None, :, c]
        if not alive.any():
            break
        n += alive
    return n


def single_edits(words: list[str], others: list[str], width: int, half: int, at_end: bool) -> np.ndarray:
    """Where the words of each pair are one edit apart, ``width`` being the longer length.

    Of the pairs with a common prefix of ``half`` or more, or (``at_end``) of the others, so that each
    pair is found on one side only.  Of words shorter than ``width`` both may not be.
    """
    before = _common(_letters(words, width, False), _letters(others, width, False), range(width))
    after = _common(_letters(words, width, True), _letters(others, width, True), reversed(range(width)))
    long = np.array([len(w) == width for w in words])[:, None] | np.array([len(w) == width for w in others])[None, :]
    return (before + after >= width - 1) & ((before < half) == at_end) & long


def tile_edits(table: pa.Table) -> pa.Table:
    """(word, n_near, best_n, best) of the words of a tile that have near ones in it.

    Rows have width, at_end, cell, block, word and n.  Words meet in a cell; one that holds two blocks has
    the pairs between them only.  A strip of rows, sorted by cell, meets the rows up to the end of its last cell.
    """
    table = table.sort_by([(c, "ascending") for c in ("width", "at_end", "cell", "block")])
    words, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    widths, at_end, cell, block, parted = (table.column(c).to_numpy(zero_copy_only=False) for c in ("width", "at_end", "cell", "block", "parted"))
    kind = np.cumsum(np.concatenate([[True], (widths[1:] != widths[:-1]) | (at_end[1:] != at_end[:-1])]))
    place = np.cumsum(np.concatenate([[True], (cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])]))
    end = np.searchsorted(place, place, side="right")
    stop = np.searchsorted(kind, kind, side="right")
    rank = np.empty(len(words), np.int64)
    by = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    rank[by] = np.arange(len(by))
    near, best, a = np.zeros(len(words), np.int64), np.full(len(words), len(words)), 0
    while a < len(words):
        width = int(widths[a])
        most = max(1, LETTERS // width)
        b = int(min(stop[a], a + min(most, 256)))
        for c in range(a, int(end[b - 1]), min(most, ENTRIES // 256)):
            d = min(int(end[b - 1]), c + min(most, ENTRIES // 256))
            close = single_edits(words[a:b], words[c:d], width, (width - 1) // 2, bool(at_end[a]))
            close &= place[a:b, None] == place[None, c:d]
            close &= ~parted[a:b, None] | (block[a:b, None] != block[None, c:d])
            i, j = np.nonzero(close & (np.arange(a, b)[:, None] < np.arange(c, d)[None, :]))
            i, j = i + a, j + c
            np.add.at(near, i, 1)
            np.add.at(near, j, 1)
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
        a = b
    some = np.flatnonzero(near)
    found = np.array(by, np.int64)[best[some]]
    return pa.table({"word": pa.array([words[i] for i in some], pa.string()), "n_near": near[some],
                     "best_n": n[found], "best": pa.array([words[i] for i in found], pa.string())})


EDITS = T.StructType([T.StructField("word", T.StringType()), T.StructField("n_near", T.LongType()),
                      T.StructField("best_n", T.LongType()), T.StructField("best", T.StringType())])


def near_words(words: DataFrame, block_rows: int = 2048, tile_rows: int = 8192) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have near ones: their number and the one of largest n.

    Of equal n the one that comes first by code points is the best.  A word of length L is in four cells: with the words of
    its own length and one less, and with those of one more, by the first and by the last half of the letters that
    must be common.  A cell of more than ``block_rows`` words falls into blocks by their hash, each pair of
    which is a cell of its own.  Cells are dealt to tiles of about ``tile_rows`` rows.
    """
    length = F.length("word")
    sides = F.array(*[F.struct((length + more).alias("width"), F.lit(at_end).alias("at_end")) for more in (0, 1) for at_end in (False, True)])
    rows = words.where(length > 0).select("word", "n", F.explode(sides).alias("s")).select("word", "n", "s.*")
    half = F.floor((F.col("width") - 1) / 2).cast("int")
    rows = rows.withColumn("half", F.when(F.col("at_end"), F.substring("word", F.length("word") - half + 1, half)).otherwise(F.substring("word", F.lit(1), half)))
    key = ["width", "at_end", "half"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1")
    sizes = stored(sizes.withColumn("blocks", F.ceil(F.col("rows") / block_rows).cast("int")), "spelling-cells")
    total = sizes.agg(F.sum(F.col("rows") * F.col("blocks"))).first()[0] or 0
    placed = rows.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("word", F.lit("block")), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64(*key, F.least("block", "other"), F.greatest("block", "other"))
    tiles = placed.select("width", "at_end", cell.alias("cell"), "block", (F.col("block") != F.col("other")).alias("parted"), "word", "n")
    tiles = tiles.withColumn("tile", F.pmod("cell", F.lit(1 + total // tile_rows)))
    found = tiles.groupBy("tile").applyInArrow(tile_edits, EDITS)
    first = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), first).select(
        "word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead from each word, by steps that double in length.

    Each word has one form at most, and no way comes back to its word.  Each round is stored.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = stored(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("went").isEmpty():
            return now


def variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of a vocabulary (word, n).

    ``form`` is the near word of largest n (of equal ones the first by code points) if its n is at least
    ``factor`` times the word's own, else null; ``root`` is where forms lead, the word itself without one.
    Each word must be there once; an empty vocabulary gives no rows.
    """
    words = stored(words.select("word", "n"), "spelling-words")
    found = words.join(near_words(words), "word", "left").withColumn("worth", F.col("best_n") >= factor * F.col("n"))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("worth"), F.col("best")).alias("form"), F.when(F.col("worth"), F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
