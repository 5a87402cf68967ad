"""Media containers, WARC archives and the pipeline."""

import base64
import gzip
import hashlib
import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchweave.llm import media, warc
from matchweave.sources.tables import shared_dir


def test_mux_and_samples_round_trip():
    for frames in (1, 2, 12, 13, 63, 64, 65, 128, 200):
        payload = bytes(np.random.default_rng(frames).integers(0, 256, 576 * frames, dtype=np.uint8))
        data = media.mux(payload)
        (track,) = media.tracks(data)
        assert media.samples(data, track) == payload
        assert (track["codec"], track["handler"], track["timescale"], track["duration"], track["track_id"]) == ("raw ", "vide", 25, frames, 1)
        assert track["sync"].tolist() == list(range(0, frames, 12))
        for i in track["sync"].tolist():
            at = int(track["offsets"][i])
            assert data[at:at + 576] == payload[576 * i:576 * (i + 1)]
    with pytest.raises(ValueError):
        media.mux(b"123")


def foreign(wide: bool) -> bytes:
    """A file of another make: 32-bit tables, varying sizes, the movie box last or a 64-bit size, no sync table."""
    sizes, body = [3, 5, 2, 7], b"aaabbbbbccddddddd"
    head = media._box(b"ftyp", b"qt  ", bytes(4))
    data = struct.pack(">I4sQ", 1, b"mdat", 16 + len(body)) + body if wide else media._box(b"mdat", body)
    first = len(head) + len(data) - len(body)
    full = media._full
    table = media._box(b"stbl", full(b"stsd", struct.pack(">I", 1), media._box(b"avc1", bytes(78))),
                       full(b"stts", struct.pack(">5I", 2, 1, 10, 3, 20)),
                       full(b"stsc", struct.pack(">7I", 2, 1, 1, 1, 2, 3, 1)),
                       full(b"stsz", struct.pack(">6I", 0, 4, *sizes)), full(b"stco", struct.pack(">3I", 2, first, first + 3)))
    mdia = media._box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 99, 0, 0)), full(b"hdlr", bytes(4), b"soun", bytes(13)),
                      media._box(b"minf", table))
    movie = media._box(b"moov", media._box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(60)), mdia))
    return head + data + (b"\0\0\0\0" + movie[4:])


@pytest.mark.parametrize("wide", [False, True])
def test_foreign_containers(wide):
    data = foreign(wide)
    (track,) = media.tracks(data)
    assert media.samples(data, track) == b"aaabbbbbccddddddd" and track["duration"] == 70 and track["codec"] == "avc1"
    assert [data[o:o + n] for o, n in zip(track["offsets"], track["sizes"])] == [b"aaa", b"bbbbb", b"cc", b"ddddddd"]
    assert track["sync"].tolist() == [0, 1, 2, 3] and track["track_id"] == 7


def fragmented(based: bool) -> bytes:
    """Empty sample tables and two fragments, the first with two runs; the second takes all but a sync mark from the defaults."""
    full, box = media._full, media._box
    table = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(78))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)),
                full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", table))
    data = box(b"moov", box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7), bytes(60)), mdia),
               box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 10, 2, 0x10000))))
    for runs, body in (([(0x701, [(5, 3, 0), (6, 1, 0x10000)]), (0x200, [(2,), (4,)])], b"aaabccdddd"), ([(0x5, [(), ()])], b"eeff")):
        for _ in range(2):  # the second time with the length known
            length = len(moof) if _ else 0
            trun = [full(b"trun", struct.pack(">I", len(rows)), struct.pack(">i", length + 8 + (0 if not based else len(data))) if f & 1 else b"",
                         struct.pack(">I", 0) if f & 4 else b"", *[struct.pack(f">{len(r)}I", *r) for r in rows], flags=f) for f, rows in runs]
            tfhd = full(b"tfhd", struct.pack(">I", 7), struct.pack(">Q", 0) if based else b"", flags=1 if based else 0x20000)
            moof = box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", tfhd, *trun))
        data += moof + box(b"mdat", body)
    return data


@pytest.mark.parametrize("based", [False, True])
def test_fragments_are_samples(based):
    data = fragmented(based)
    (track,) = media.tracks(data)
    assert [data[o:o + n] for o, n in zip(track["offsets"], track["sizes"])] == [b"aaa", b"b", b"cc", b"dddd", b"ee", b"ff"]
    assert media.samples(data, track) == b"aaabccddddeeff" and track["duration"] == 5 + 6 + 4 * 10
    assert track["sync"].tolist() == [0, 4]
    for broken in (data[:-1], data.replace(b"trex", b"free"), data.replace(b"tfhd", b"free")):
        with pytest.raises(ValueError):
            media.tracks(broken)


def test_inspect_and_store(spark):
    good = media.mux(b"\x01" * 576 * 30)
    rng = np.random.default_rng(1)
    rows = [(1, good), (2, None), (3, b""), (4, good[:700]), (5, b"\0\0\0\x04moov"), (6, good)]
    for k in range(60):  # damaged at random places: an error or a result, never a crash
        broken = bytearray(good)
        for _ in range(4):
            broken[int(rng.integers(len(broken) - 900, len(broken)))] = int(rng.integers(256))
        rows.append((100 + k, bytes(broken)))
    got = {r.id: r for r in media.inspect(spark.createDataFrame(rows, "id long, media binary"), payload=True).collect()}
    assert len(got) == len(rows) and got[1].tracks == got[6].tracks and got[1].payload == b"\x01" * 576 * 30
    assert [tuple(k) for k in got[1].tracks[0].keyframes] == [(32, 576), (32 + 576 * 12, 576), (32 + 576 * 24, 576)]
    assert got[2].tracks == got[3].tracks == [] and got[3].media_error is None and got[5].media_error
    texts = [None, "", "é" * 288, "x" * 577, "long " * 40_000]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    stored = media.inspect(media.store_texts(df), payload=True).collect()
    for r in stored:
        raw = (r.text or "").encode()
        want = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert r.n_bytes == len(raw) and r.payload == want
    assert media.inspect(media.store_texts(df.limit(0))).count() == 0


def pages(spark):
    rows = [(5, "http://a/é x", "<p>one</p>"), (3, None, "<p>one</p>"), (9, "u", None), (8, "u", ""), (None, "u\r\nX: y", "<p>one</p>"), (None, "u", "zwei é"),
            (4, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 50), (6, "u", "big " * 700_000), (3, "again", "<p>one</p>"), (7, "u", "tiny")]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, first int"), rows


def test_warc_round_trip(spark):
    df, rows = pages(spark)
    got = warc.round_trip(df).select("record_type", "payload_digest", "payload_bytes", "payload", "uri", warc.page_of(F.col("record_id")).alias("page"),
                                     warc.page_of(F.col("refers_to")).alias("first")).collect()
    assert len(got) == len(rows)
    least = {}
    for page, _, html in rows:
        if page is not None:
            least[html or ""] = min(page, least.get(html or "", page))
    want = []
    for page, _, html in rows:
        raw, first = (html or "").encode(), least.get(html or "")
        revisit = first is not None and page != first
        want.append((page, "revisit" if revisit else "response", first if revisit else None, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    assert sorted(((r.page, r.record_type, r.first, r.payload_bytes, r.payload_digest) for r in got), key=str) == sorted(want, key=str)
    assert {r.payload.decode() for r in got if r.payload is not None} == {html or "" for *_, html in rows}
    assert all("\n" not in (r.uri or "") for r in got)
    long = warc.round_trip(df, 5).where("record_type = 'revisit'").count()
    assert long == sum(w[1] == "revisit" and w[3] >= 5 for w in want)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_normalised_archives_are_members_with_an_index(spark):
    df, rows = pages(spark)
    manifest = warc.write_archives(df, shared_dir(spark, "test"))
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    whole = b""
    for r in manifest.collect():
        with open(r.path.removeprefix("file:"), "rb") as f:
            engine = zlib.decompressobj(wbits=31)
            whole += engine.decompress(f.read())
            assert engine.eof and not engine.unused_data  # one stream for the whole archive
    index = warc.normalise(manifest, shared_dir(spark, "test"))
    again = b""
    for path in sorted({r.path for r in index.collect()}):
        at = 0
        local = path.removeprefix("file:")
        with open(local, "rb") as f, open(local + ".index.jsonl") as sidecar:
            data, lines = f.read(), [json.loads(x) for x in sidecar]
        for x in lines:
            assert x["offset"] == at
            again += zlib.decompress(data[at:at + x["length"]], wbits=31)
            at += x["length"]
        assert at == len(data) and len(lines) == index.where(F.col("path") == path).count()
    assert sorted(whole.split(b"WARC/1.1\r\nWARC-Type")) == sorted(again.split(b"WARC/1.1\r\nWARC-Type"))


def test_streams_of_any_members_and_damage():
    records = [warc.record(i, "u", b"x" * n, "D", None) for i, n in enumerate((0, 1, 5000, 3_000_000))]
    whole = b"".join(records)
    for packed in (gzip.compress(whole), b"".join(map(gzip.compress, records))):
        for block in (1 << 20, 777):
            blocks = [packed[i:i + block] for i in range(0, len(packed), block)]
            got = [b"".join(body) for _, body in warc.split_records(warc.inflate(blocks))]
            assert got == records
    with pytest.raises(ValueError):
        list(warc.inflate([gzip.compress(whole)[:-20]]))
    with pytest.raises(ValueError):
        [b"".join(body) for _, body in warc.split_records([whole[:-9]])]
    assert list(warc.split_records([])) == []
