"""Repeats of long byte strings: run-length indexes of what documents may share.

Every string of ``length`` bytes holds an anchor, the short gram with the smallest hash in it, so
equal strings meet at equal anchors.  Anchors with several different surroundings are dealt to shards.
A shard's surroundings get a run-length Burrows-Wheeler transform with samples at the ends of its runs;
streaming the texts past the samples gives, for each byte, the length of its longest match and where it is.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchweave.llm.common import bounded, stored

#: Bytes whose hashes are held at a time; bytes of text whose anchors a worker collects before it hands them on.
STRIP, CHUNK = 1 << 18, 48 << 20
_ONE = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit values spread evenly (multiplications and shifts that can be undone)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


def _slide(values: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        values, n = best(values[:-n], values[n:]), 2 * n
    return best(values[:len(values) - (width - n)], values[width - n:]) if n < width else values


class Anchors:
    """Finds the anchors of texts; grams have ``gram`` bytes, a string of ``length`` bytes has one at least.

    Hashes are differences of running sums, so a gram or a surrounding is hashed in a few steps for
    each byte, however long it is.
    """

    def __init__(self, length: int, gram: int):
        self.length, self.gram = length, gram
        self.letters = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_STEP))

    def _sums(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw) + 1
        if n > len(getattr(self, "up", ())):
            self.up, self.down = _powers(_STEP, n), _powers(pow(_STEP, -1, 1 << 64), n)
        sums = np.zeros(n, np.uint64)
        np.cumsum(self.letters[raw] * self.up[:len(raw)], out=sums[1:])
        return sums, self.down

    def find(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Number of the text, position in it, hash of the gram and of the surroundings of each anchor.

        ``raw`` holds the texts one after another.  The surroundings are the bytes of all strings of
        ``length`` bytes of the text in which the anchor can be: ``length - gram`` before and after it.
        """
        gram, length = self.gram, self.length
        ends = np.cumsum(sizes)
        if len(raw) < length:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        sums, down = self._sums(raw)
        width = length - gram + 1
        hashes = _mixed((sums[gram:] - sums[:-gram]) * down[:len(raw) - gram + 1])
        least = _slide(hashes, width, np.minimum)
        whole = np.zeros(len(least), bool)
        for end, size in zip(ends.tolist(), sizes.tolist()):
            if size >= length:
                whole[end - size:end - length + 1] = True
        shown = np.zeros(len(least) + 2 * (width - 1), np.uint64)
        shown[width - 1:width - 1 + len(least)] = np.where(whole, least, 0)
        at = np.flatnonzero((_slide(shown, width, np.maximum) == hashes) & (hashes > 0))
        text = np.searchsorted(ends, at, side="right")
        start = (ends - sizes)[text]
        low, high = np.maximum(start, at - (length - gram)), np.minimum(ends[text], at + length)
        around = _mixed(((sums[high] - sums[low]) * down[low]) ^ ((high - low) * 1024 + (at - low)).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        return text, at - start, hashes[at].view(np.int64), around.view(np.int64)


_ROWS = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "around", "who", "part", "pos")] + [T.StructField("later", T.BinaryType())])
#: A place as it is packed in ``later``.
_PLACE = np.dtype([("who", "<i8"), ("part", "<i8"), ("pos", "<i8")])


def _strips(batch: pa.RecordBatch):
    """(rows, bytes, sizes) of slices of a batch with about STRIP bytes of text, or one row."""
    for part in bounded(iter([batch]), "text", STRIP):
        texts = part.column("text")
        low, high = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]].tolist()
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[low:high] if data is not None else np.zeros(0, np.uint8)
        yield part, raw, np.diff(np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]).astype(np.int64)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, around, who, part, pos, later) of documents (who, part, text).

    A worker reduces what it collects: of equal anchors with equal surroundings one row is handed on, that of the
    smallest (who, part, pos), and ``later`` has the places of the others.
    """
    def reduced(found):
        anchor, around, who, part, pos = map(np.concatenate, zip(*found))
        order = np.lexsort((pos, part, who, around, anchor))
        columns = [c[order] for c in (anchor, around, who, part, pos)]
        places = _changes(*columns)
        anchor, around, who, part, pos = (c[places] for c in columns)
        first = np.flatnonzero(_changes(anchor, around))
        packed = np.rec.fromarrays([who, part, pos], dtype=_PLACE)
        later = [packed[a + 1:b].tobytes() if b > a + 1 else None for a, b in zip(first.tolist(), [*first[1:].tolist(), len(anchor)])]
        return pa.RecordBatch.from_arrays([*[pa.array(c[first]) for c in (anchor, around, who, part, pos)], pa.array(later, pa.binary())], names=_ROWS.names)

    def run(batches):
        finder, found, held = Anchors(length, gram), [], 0
        for batch in batches:
            for rows, raw, sizes in _strips(batch):
                text, pos, anchor, around = finder.find(raw, sizes)
                who, part = (rows.column(c).to_numpy()[text] for c in ("who", "part"))
                found.append((anchor, around, who, part, pos))
                held += len(raw)
                if held >= CHUNK:
                    yield reduced(found)
                    found, held = [], 0
        if found:
            yield reduced(found)

    return docs.select("who", "part", "text").mapInArrow(run, _ROWS)


_MET = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "who", "part", "pos")] + [T.StructField("later", T.BooleanType())])


def met(rows: DataFrame) -> DataFrame:
    """(anchor, who, part, pos, later) of the anchors that are in several places.

    ``later`` ones stand in the same surroundings as an earlier place; of the others, those whose anchor has several
    surroundings, the first place of each is there.  Rows are sorted and streamed: a task holds
    one batch, however often an anchor occurs.
    """
    def run(batches):
        before = waiting = None  # the last row, and the first place of an anchor that has had one surrounding so far
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, around, *place = (batch.column(c).to_numpy() for c in ("anchor", "around", "who", "part", "pos"))
            new_anchor, new, moved = _changes(anchor), _changes(anchor, around), _changes(*place)
            if before is not None:
                new_anchor[0], new[0] = anchor[0] != before[0], (anchor[0], around[0]) != before[:2]
                moved[0] = tuple(c[0] for c in place) != before[2]
            first = np.flatnonzero(new)
            several = ~new_anchor[first]
            several[:-1] |= ~new_anchor[first[1:]]
            copies = np.flatnonzero(~new & moved)
            packed = np.frombuffer(b"".join(pc.drop_null(batch.column("later")).to_pylist()), _PLACE)
            out = [(anchor[first[several]], *(c[first[several]] for c in place), np.zeros(several.sum(), bool)),
                   (anchor[copies], *(c[copies] for c in place), np.ones(len(copies), bool)),
                   (np.zeros(len(packed), np.int64), *(packed[c] for c in _PLACE.names), np.ones(len(packed), bool))]
            if len(first):
                if waiting and not new_anchor[first[0]]:
                    out.append(tuple(np.array([v]) for v in (*waiting, False)))
                waiting = None if several[-1] else (anchor[first[-1]], *(c[first[-1]] for c in place))
            before = (anchor[-1], around[-1], tuple(c[-1] for c in place))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=_MET.names)

    return rows.repartition("anchor").sortWithinPartitions("anchor", "around", "who", "part", "pos").mapInArrow(run, _MET)


def suffix_rows(raw: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The row of each byte's suffix among the sorted suffixes.

    ``ends`` is where the text of each byte ends and ``owner`` the number of that text; a suffix ends with its text, and
    equal ones come in the order of the texts.  Prefixes of doubling length are sorted, and only those that
    are still shared go on to the next length.
    """
    n, at = len(raw), np.arange(len(raw))
    padded = np.concatenate([raw.astype(np.int64) + 1, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | np.where(at + k < ends, padded[k:n + k], 0)
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(_changes(key[order]))
    row = np.empty(n, np.int64)
    row[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    texts, known = int(owner[-1]) + 1 if n else 0, 7
    open_ = order[np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))]
    while len(open_):
        beyond = open_ + known
        inside = beyond < ends[open_]
        second = np.where(inside, texts + row[np.minimum(beyond, n - 1)], owner[open_])
        own = row[open_]
        order = np.argsort(own * (n + texts + 1) + second)
        open_, own, second = open_[order], own[order], second[order]
        old, new = _changes(own), _changes(own, second)
        first = np.flatnonzero(old)
        group = np.repeat(first, np.diff(np.append(first, len(open_))))
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(open_)))
        row[open_] = own + np.repeat(heads, sizes) - group
        open_ = open_[np.repeat(sizes > 1, sizes)]
        known *= 2
    return row


def _common(padded: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the bytes at ``a`` and at ``b``, up to ``most``."""
    words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 7, 8), (1, 1))
    out, going, done = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(going):
        x = words[a[going] + done].view("<u8")[:, 0] ^ words[b[going] + done].view("<u8")[:, 0]
        low = x & (~x + np.uint64(1))
        here = np.where(x == 0, 8, (np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64))
        out[going] = np.minimum(done + here, most[going])
        done += 8
        going = going[(here == 8) & (most[going] > done)]
    return out


@dataclasses.dataclass
class RunIndex:
    """A run-length Burrows-Wheeler transform of texts, with samples at its runs.

    ``symbols`` and ``lengths`` are the runs (a text's end is 256 and always a run of its own).  At the first row of each
    run is sampled: the byte its suffix starts at, the byte that the row before starts at, and how far
    both agree.  They are kept in the order of the bytes.
    """

    symbols: np.ndarray
    lengths: np.ndarray
    at: np.ndarray
    match: np.ndarray
    agree: np.ndarray

    @classmethod
    def build(cls, raw: np.ndarray, sizes: np.ndarray) -> RunIndex:
        """The index of non-empty texts, given one after another."""
        ends = np.repeat(np.cumsum(sizes), sizes)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        row = suffix_rows(raw, ends, owner)
        suffix = np.empty(len(raw), np.int64)
        suffix[row] = np.arange(len(raw))
        last = np.where(suffix == (ends[suffix] - sizes[owner[suffix]]), 256, raw[suffix - 1].astype(np.int64))
        heads = np.flatnonzero(_changes(last) | (last == 256))
        at, match = suffix[heads], suffix[np.maximum(heads - 1, 0)]
        padded = np.concatenate([raw, np.zeros(16, np.uint8)])
        agree = np.where(heads > 0, _common(padded, at, match, np.minimum(ends[at] - at, ends[match] - match)), 0)
        order = np.argsort(at)
        return cls(last[heads], np.diff(np.append(heads, len(raw))), at[order], match[order], agree[order])

    def stream(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the texts: its longest match with the suffix sorted before it, and where that is.

        Between two samples a match moves on by one byte with each byte of the text and gets shorter by one.
        """
        nearest = np.zeros(n, np.int64)
        nearest[self.at] = np.arange(len(self.at))
        nearest = np.maximum.accumulate(nearest)
        moved = np.arange(n) - self.at[nearest]
        return self.agree[nearest] - moved, self.match[nearest] + moved


def earlier_copies(lengths: np.ndarray, match: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at each place also stand at a place of smaller ``order``.

    Matches of at least ``length`` tie a place to the one sorted before it; all places of one string are a
    chain, whose ends are found by steps that double.
    """
    top = np.arange(len(match))
    tied = np.flatnonzero(lengths >= length)
    top[tied] = match[tied]
    while len(tied):
        further = top[top[tied]]
        if (further == top[tied]).all():
            break
        top[tied] = further
    least = order.copy()
    np.minimum.at(least, top[tied], order[tied])
    return order > least[top]


_SPANS = T.StructType([T.StructField(c, T.LongType()) for c in ("who", "part", "start", "end")])


def shard_spans(length: int):
    """A function for the surroundings of a shard: (who, part, start, end) of the bytes that have an earlier copy."""
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("who", "part", "start")])
        who, part, start = (table.column(c).to_numpy() for c in ("who", "part", "start"))
        texts = table.column("bytes").to_pylist()
        raw = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        index = RunIndex.build(raw, sizes)
        lengths, match = index.stream(len(raw))
        first = np.cumsum(sizes) - sizes
        inside = np.arange(len(raw)) - np.repeat(first, sizes)
        document = np.cumsum(_changes(who, part)) - 1
        order = np.repeat(document << 40, sizes) + np.repeat(start, sizes) + inside
        copies = np.flatnonzero(earlier_copies(lengths, match, order, length))
        owner = np.repeat(np.arange(len(sizes)), sizes)[copies]
        new = _changes(owner)
        new[1:] |= copies[1:] > copies[:-1] + length
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(copies)) - 1
        own = owner[heads] if len(heads) else np.zeros(0, np.int64)
        return pa.table({"who": who[own], "part": part[own], "start": start[own] + inside[copies[heads]],
                         "end": start[own] + inside[copies[tails[:len(heads)]]] + length})

    return run


_CUT = T.StructType([T.StructField(c, T.LongType()) for c in ("anchor", "who", "part", "start")] + [T.StructField("bytes", T.BinaryType())])


def surroundings(docs: DataFrame, places: DataFrame, length: int, gram: int) -> DataFrame:
    """(anchor, who, part, start, bytes): what is around the ``places`` (anchor, who, part, pos) of the documents."""
    found = places.groupBy("who", "part").agg(F.collect_list(F.struct("anchor", "pos")).alias("places"))

    def run(batches):
        for batch in batches:
            for rows in bounded(iter([batch]), "text"):
                lists = rows.column("places")
                of = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
                anchor, pos = (pc.struct_field(lists.flatten(), c) for c in ("anchor", "pos"))
                starts = np.maximum(pos.to_numpy() - (length - gram), 0)
                texts = [t.encode() for t in rows.column("text").to_pylist()]
                cut = [texts[i][a:b] for i, a, b in zip(of.tolist(), starts.tolist(), (pos.to_numpy() + length).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [anchor, *(rows.column(c).take(pa.array(of)) for c in ("who", "part")), pa.array(starts), pa.array(cut, pa.binary())], names=_CUT.names)

    return docs.join(found, ["who", "part"]).select("who", "part", "text", "places").mapInArrow(run, _CUT)


def string_spans(cut: DataFrame, length: int) -> DataFrame:
    """What ``shard_spans`` finds, for anchors with more surroundings than a shard should hold: by the hash of each string.

    Each string is a row, so no row or task grows with the number of surroundings; hashes have 128 bits.
    """
    each = cut.select("who", "part", "start", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("s"))
    string = F.substring("bytes", F.col("s") + 1, length)
    each = each.select(F.struct("who", "part", (F.col("start") + F.col("s")).alias("start")).alias("place"),
                       F.xxhash64(string).alias("h"), F.xxhash64(F.lit(length), string).alias("g"))
    first = each.groupBy("h", "g").agg(F.min("place").alias("first"))
    later = each.join(first, ["h", "g"]).where("place > first").select("place.*")
    return later.select("who", "part", "start", (F.col("start") + length).alias("end"))


_KEPT = [T.StructField("n_bytes", T.LongType()),
         T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
         T.StructField("kept", T.BinaryType())]


def _covered(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, bytes]:
    """The maximal runs of bytes that the spans cover, and the other bytes."""
    edge = np.zeros(len(raw) + 1, np.int64)
    np.add.at(edge, np.maximum(starts, 0), 1)
    np.add.at(edge, np.minimum(ends, len(raw)), -1)
    over = np.cumsum(edge) > 0
    turns = np.flatnonzero(np.diff(over, prepend=False))
    return turns[::2], turns[1::2], raw[~over[:-1]].tobytes()


def _kept(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, places) as doc_id, n_bytes, removed, kept."""
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for rows in bounded(iter([batch]), "text"):
                lists, sizes, removed, kept = rows.column("places"), [], [], []
                counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                starts, ends = (pc.struct_field(lists.flatten(), c).to_numpy(zero_copy_only=False) for c in ("start", "end"))
                stops = np.cumsum(counts)
                for text, n, stop in zip(rows.column("text").to_pylist(), counts.tolist(), stops.tolist()):
                    data, spans = text.encode(), []
                    sizes.append(len(data))
                    if n:
                        a, b, data = _covered(np.frombuffer(data, np.uint8), starts[stop - n:stop], ends[stop - n:stop])
                        spans = [{"start": x, "end": y} for x, y in zip(a.tolist(), b.tolist())]
                    removed.append(spans)
                    kept.append(data)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kinds), pa.array(kept, pa.binary())],
                                                 names=["doc_id", "n_bytes", "removed", "kept"])

    return docs.select("doc_id", "text", "places").mapInArrow(run, T.StructType([docs.schema["doc_id"], *_KEPT]))


def without_repeats(df: DataFrame, length: int = 100, gram: int = 32, shard_bytes: int = 1 << 20, most: int = 8192,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: the text's bytes without those of repeated strings.

    A byte goes if some ``length`` bytes that it is part of also start earlier: in a document of
    smaller doc_id, or in the same one, overlapping or not.  ``removed`` has the maximal runs (start, end) of such
    bytes, ``kept`` the others; a character may be cut.  A null text is empty and a null doc_id the largest.
    Rows of one doc_id and one text are one document; different texts of a doc_id come in the order of their hash.

    Equal surroundings count once before and after the shuffle.  An index holds about ``shard_bytes`` of
    surroundings; an anchor with more than ``most`` of them goes by the strings' hashes instead.
    """
    own = df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = own.select(F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("who"), F.xxhash64("text").alias("part"), "doc_id", "text")
    places = stored(met(anchor_rows(docs, length, gram)), "repeats-places")
    firsts = places.where("not later").select("anchor", "who", "part", "pos")
    busy = firsts.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most).select("anchor", F.lit(True).alias("busy"))
    firsts = stored(firsts.join(busy, "anchor", "left").withColumn("busy", F.coalesce("busy", F.lit(False))), "repeats-firsts")
    shards = 1 + firsts.where("not busy").count() * (2 * length - gram) // shard_bytes
    cut = surroundings(docs, firsts.where("not busy"), length, gram).withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    spans = cut.groupBy("shard").applyInArrow(shard_spans(length), _SPANS)
    busy_spans = string_spans(surroundings(docs, firsts.where("busy"), length, gram), length)
    later = places.where("later").select("who", "part", (F.col("pos") - (length - gram)).alias("start"), (F.col("pos") + length).alias("end"))
    marks = spans.unionByName(busy_spans).unionByName(later).groupBy("who", "part").agg(F.collect_list(F.struct("start", "end")).alias("places"))
    return _kept(docs.join(marks, ["who", "part"], "left"))
