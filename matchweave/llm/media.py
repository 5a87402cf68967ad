"""ISO media containers: their boxes, sample tables, durations and keyframe byte ranges."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchweave.llm.common import append, texts_of

#: Boxes that hold boxes only.
CONTAINERS = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"))


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def mux(payload: bytes, side: int = 24, keyframe_every: int = 12, per_chunk: int = 64, timescale: int = 25) -> bytes:
    """A file with one video track of uncompressed 8-bit grey frames of ``side`` by ``side`` samples.

    The payload is a positive multiple of a frame; it is stored as it is, in chunks of ``per_chunk``
    frames, and every ``keyframe_every``-th frame from the first is marked as a sync sample.
    """
    frame = side * side
    if not payload or len(payload) % frame:
        raise ValueError("the payload is no positive multiple of a frame")
    frames = len(payload) // frame
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")
    data = _box(b"mdat", payload)
    first = len(head) + len(data) - len(payload)
    chunks = -(-frames // per_chunk)
    last = frames - (chunks - 1) * per_chunk
    runs = [(1, min(per_chunk, frames), 1)] + [(chunks, last, 1)] * (chunks > 1 and last != per_chunk)
    sync = range(1, frames + 1, keyframe_every)
    unity = struct.pack(">9i", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", side, side, 72 << 16, 72 << 16, 0, 1),
                 bytes(32), struct.pack(">Hh", 8, -1))
    table = _box(
        b"stbl", _full(b"stsd", struct.pack(">I", 1), entry), _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(f">I{len(sync)}I", len(sync), *sync)),
        _full(b"stsc", struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
        _full(b"stsz", struct.pack(">II", frame, frames)),
        _full(b"co64", struct.pack(f">I{chunks}Q", chunks, *range(first, first + frames * frame, per_chunk * frame))))
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, timescale, frames, 0x55C4, 0), version=1),
                _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, frames), bytes(16), unity, struct.pack(">II", side << 16, side << 16), version=1, flags=7)
    mvhd = _full(b"mvhd", struct.pack(">QQIQ", 0, 0, timescale, frames), struct.pack(">IH", 1 << 16, 1 << 8), bytes(10), unity, bytes(24),
                 struct.pack(">I", 2), version=1)
    return head + data + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def walk(data: bytes, start: int, end: int):
    """(kind, start, end) of the boxes between two places, without their headers."""
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, body, start + size
        start += size


def _numbers(data: bytes, box: tuple[int, int], kind: str, skip: int, width: int = 1) -> np.ndarray:
    """The counted table in a box: ``width`` numbers an entry, after ``skip`` bytes."""
    n = struct.unpack_from(">I", data, box[0] + skip)[0]
    at, size = box[0] + skip + 4, n * width * np.dtype(kind).itemsize
    if at + size > box[1]:
        raise ValueError("a table is cut off")
    return np.frombuffer(data, kind, n * width, at).astype(np.int64).reshape(-1, width)


def _sizes(data: bytes, boxes: dict) -> np.ndarray:
    if b"stsz" in boxes:
        box = boxes[b"stsz"]
        same, n = struct.unpack_from(">II", data, box[0] + 4)
        return np.full(n, same, np.int64) if same else _numbers(data, box, ">u4", 8)[:, 0]
    box = boxes[b"stz2"]
    width, n = data[box[0] + 7], struct.unpack_from(">I", data, box[0] + 8)[0]
    if width == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, box[0] + 12)
        return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)
    return _numbers(data, box, {8: ">u1", 16: ">u2"}[width], 8)[:, 0]


def _track(data: bytes, start: int, end: int) -> dict:
    """A track's description, with the places of its samples (``offsets`` and ``sizes``)."""
    boxes, todo = {}, [(start, end)]
    while todo:
        for kind, a, b in walk(data, *todo.pop()):
            if kind in CONTAINERS:
                todo.append((a, b))
            else:
                boxes.setdefault(kind, (a, b))
    head = boxes[b"tkhd"][0]
    track_id = struct.unpack_from(">I", data, head + (20 if data[head] else 12))[0]
    head = boxes[b"mdhd"][0]
    timescale, duration = struct.unpack_from(">IQ", data, head + 20) if data[head] else struct.unpack_from(">II", data, head + 12)
    entries = list(walk(data, boxes[b"stsd"][0] + 8, boxes[b"stsd"][1]))
    sizes = _sizes(data, boxes)
    places = _numbers(data, boxes[b"stco"], ">u4", 4) if b"stco" in boxes else _numbers(data, boxes[b"co64"], ">u8", 4)
    runs = _numbers(data, boxes[b"stsc"], ">u4", 4, 3)
    until = np.append(runs[1:, 0], len(places) + 1)
    in_chunk = np.repeat(runs[:, 1], until - runs[:, 0])
    if len(in_chunk) != len(places) or in_chunk.sum() != len(sizes):
        raise ValueError("the sample tables do not agree")
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(in_chunk) - in_chunk
    offsets = np.repeat(places[:, 0] - before[np.minimum(first, max(len(sizes) - 1, 0))], in_chunk) + before if len(sizes) else sizes
    if len(sizes) and (offsets.min() < 0 or (offsets + sizes).max() > len(data)):
        raise ValueError("samples lie outside the file")
    sync = _numbers(data, boxes[b"stss"], ">u4", 4)[:, 0] - 1 if b"stss" in boxes else np.arange(len(sizes))
    ticks = _numbers(data, boxes[b"stts"], ">u4", 4, 2).prod(1).sum() if b"stts" in boxes else duration
    return {"track_id": track_id, "handler": data[boxes[b"hdlr"][0] + 8:boxes[b"hdlr"][0] + 12].decode("latin-1"),
            "codec": entries[0][0].decode("latin-1") if entries else "", "timescale": timescale, "duration": int(ticks),
            "offsets": offsets, "sizes": sizes, "sync": sync}


def _run(data: bytes, start: int, end: int, at: int, defaults: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes and sync marks of the samples of a trun box, whose first one is at ``at``, and their ticks."""
    flags, n = struct.unpack_from(">II", data, start)
    place = start + 8 + 4 * bool(flags & 1)
    first_flags = struct.unpack_from(">I", data, place)[0] if flags & 4 else None
    place += 4 * bool(flags & 4)
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if place + 4 * n * len(fields) > end or n > len(data):
        raise ValueError("a run of samples is longer than its box")
    rows = np.frombuffer(data, ">u4", n * len(fields), place).reshape(n, len(fields)).astype(np.int64)
    ticks, sizes, marks = [rows[:, fields.index(bit)] if bit in fields else np.full(n, value)
                           for bit, value in zip((0x100, 0x200, 0x400), defaults)]
    if n and first_flags is not None:
        marks = np.append(first_flags, marks[1:])
    return at + np.cumsum(sizes) - sizes, sizes, marks & 0x10000 == 0, int(ticks.sum())


def _fragment(data: bytes, whole: int, start: int, end: int, by_id: dict[int, dict], extends: dict[int, list[int]]) -> None:
    """Append the samples of the moof box at ``whole`` to their tracks."""
    after = whole  # the base of a fragment that names none: the end of the data before it
    for kind, a, b in walk(data, start, end):
        if kind != b"traf":
            continue
        boxes = list(walk(data, a, b))
        head = next(x for k, x, _ in boxes if k == b"tfhd")
        flags, track_id = struct.unpack_from(">II", data, head)
        track, defaults, place = by_id[track_id], [*extends[track_id]], head + 8
        at = whole if flags & 0x20000 else after
        if flags & 1:
            at, place = struct.unpack_from(">Q", data, place)[0], place + 8
        place += 4 * bool(flags & 2)
        for i, bit in enumerate((8, 0x10, 0x20)):
            if flags & bit:
                defaults[i], place = struct.unpack_from(">I", data, place)[0], place + 4
        base = after = at
        for k, x, y in boxes:
            if k == b"trun":
                if data[x + 3] & 1:
                    after = base + struct.unpack_from(">i", data, x + 8)[0]
                offsets, sizes, sync, ticks = _run(data, x, y, after, defaults)
                after += int(sizes.sum())
                if len(sizes) and (offsets.min() < 0 or after > len(data)):
                    raise ValueError("samples lie outside the file")
                track["more"].append((offsets, sizes, sync))
                track["ticks"] += ticks


def tracks(data: bytes) -> list[dict]:
    """The tracks of a file, with the samples of its movie fragments; raises ValueError if the file is damaged."""
    try:
        found, extends, fragments, whole = [], {}, [], 0
        for kind, start, end in walk(data, 0, len(data)):
            if kind == b"moov":
                found += [_track(data, a, b) for k, a, b in walk(data, start, end) if k == b"trak"]
                for k, a, b in walk(data, start, end):
                    for k, c, _ in walk(data, a, b) if k == b"mvex" else ():
                        if k == b"trex":
                            track_id, *defaults = struct.unpack_from(">I4x3I", data, c + 4)
                            extends[track_id] = defaults
            elif kind == b"moof":
                fragments.append((whole, start, end))
            whole = end
        if fragments:
            by_id = {t["track_id"]: t | {"more": [], "ticks": 0} for t in found}
            for f in fragments:
                _fragment(data, *f, by_id, extends)
            for t in found:
                more, ticks = by_id[t["track_id"]]["more"], by_id[t["track_id"]]["ticks"]
                if more:
                    offsets, sizes, sync = map(np.concatenate, zip(*more))
                    t["duration"] = ticks + (t["duration"] if len(t["sizes"]) else 0)
                    t["sync"] = np.append(t["sync"], len(t["sizes"]) + np.flatnonzero(sync)).astype(np.int64)
                    t["offsets"], t["sizes"] = np.append(t["offsets"], offsets).astype(np.int64), np.append(t["sizes"], sizes).astype(np.int64)
        return found
    except (struct.error, IndexError, KeyError, OverflowError, StopIteration) as wrong:
        raise ValueError(f"damaged: {wrong!r}") from wrong


def samples(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order, found through its tables."""
    view = memoryview(data)
    starts, ends = track["offsets"], track["offsets"] + track["sizes"]
    breaks = np.flatnonzero(starts[1:] != ends[:-1]) + 1
    return b"".join(view[a:b] for a, b in zip(starts[np.append(0, breaks)].tolist(), ends[np.append(breaks, len(ends)) - 1].tolist())
                    ) if len(starts) else b""


_KEYFRAMES = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
_TRACKS = pa.list_(pa.struct([
    ("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()),
    ("duration", pa.int64()), ("n_samples", pa.int64()), ("keyframes", _KEYFRAMES)]))
_SPARK_TRACKS = T.ArrayType(T.StructType([
    T.StructField("track_id", T.LongType()), T.StructField("handler", T.StringType()), T.StructField("codec", T.StringType()),
    T.StructField("timescale", T.LongType()), T.StructField("duration", T.LongType()), T.StructField("n_samples", T.LongType()),
    T.StructField("keyframes", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])))]))


def _described(track: dict) -> dict:
    at = track["sync"]
    keyframes = [{"offset": o, "length": n} for o, n in zip(track["offsets"][at].tolist(), track["sizes"][at].tolist())]
    return {k: track[k] for k in ("track_id", "handler", "codec", "timescale", "duration")} | {
        "n_samples": len(track["sizes"]), "keyframes": keyframes}


def inspect(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``df`` with ``tracks`` and ``media_error`` of the file in column ``media``; no payload is decoded.

    Duration is in ticks of the timescale.  Samples of movie fragments (moof) follow those of the
    movie's own tables; their decode times (tfdt) are not read.  Null, empty and damaged files have no tracks; a damaged
    one has its error.  With ``payload`` there is also the column ``payload``: the bytes of the first
    track's samples (null without one).
    """
    def one(data):
        try:
            found = tracks(data or b"")
            return [_described(t) for t in found], None, samples(data, found[0]) if payload and found else None
        except (ValueError, IndexError) as wrong:
            return [], str(wrong), None

    def compute(batch):
        rows = [one(x) for x in batch.column(media).to_pylist()]
        out = [pa.array([r[0] for r in rows], _TRACKS), pa.array([r[1] for r in rows], pa.string())]
        return out + ([pa.array([r[2] for r in rows], pa.binary())] if payload else [])

    fields = [T.StructField("tracks", _SPARK_TRACKS), T.StructField("media_error", T.StringType())]
    return append(df, media, fields + [T.StructField("payload", T.BinaryType())] * payload, compute)


def store_texts(df: DataFrame, text: str = "text", side: int = 24) -> DataFrame:
    """``df`` with ``media``, a file that holds the text's UTF-8 bytes, filled up with 255, and ``n_bytes``.

    Null and empty texts are stored as one frame of 255.
    """
    frame = side * side

    def compute(batch):
        raw = [t.encode() for t in texts_of(batch, text)]
        files = [mux(x + b"\xff" * (max(frame, -(-len(x) // frame) * frame) - len(x)), side) for x in raw]
        return [pa.array(files, pa.binary()), pa.array(list(map(len, raw)), pa.int64())]

    return append(df, text, [T.StructField("media", T.BinaryType()), T.StructField("n_bytes", T.LongType())], compute)
