"""WARC archives: written as one gzip stream each, normalised to one member per record, read by offset.

Files go to the cluster's shared folder under names of their own for each attempt of a task; the
stored manifest and index say which ones count, so a lost executor leaves files behind, no errors.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import urllib.parse
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchweave.llm.common import bounded, stored
from matchweave.sources.tables import shared_dir

#: Uncompressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
#: Member bytes that one task reads back.
READ_BYTES = 64 << 20
_BLOCK = 1 << 20
_LEVEL = 5
_GZIP = 31
#: A record's header larger than this is taken for damage.
_MOST_HEADER = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, records long"
INDEX = "path string, offset long, length long, record_type string, record_id string"
RECORDS = ("record_type string, record_id string, uri string, refers_to string, payload_digest string, "
           "payload_bytes long, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def page_of(record_id):
    """The page number in a record id, as a column; null if the page had none."""
    return F.regexp_extract(record_id, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")


def record(page_id, url: str | None, payload: bytes, digest: str, first) -> bytes:
    """A response, or a revisit of the page ``first`` if that is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_id(page_id)}",
             "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    if first is not None:
        lines += [f"WARC-Refers-To: {_id(first)}", f"WARC-Profile: {_PROFILE}"]
    body = http + (payload if first is None else b"")
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _file(uri: str):
    """The file system and path of a URI or absolute path; it is reached through Arrow, local or not."""
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """The manifest (path, records) of archives with a record for each page, stored.

    ``pages`` has page_id, url and html (null: an empty payload).  Of equal payloads of at least
    ``min_revisit_bytes`` bytes the smallest page_id is the response and the others refer to it, as
    do all rows of a null page_id; rows that repeat the smallest page_id are responses too.  Each
    archive is one gzip stream, as some crawlers write them.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = rows.groupBy("digest", F.octet_length("payload").alias("size")).agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where(
        (F.col("n") > 1) & (F.col("size") >= min_revisit_bytes) & F.col("first").isNotNull()).select("digest", "first")
    marked = rows.join(stored(repeated, "repeated"), "digest", "left").withColumn(
        "first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))

    def run(batches):
        out, written, done = None, 0, []

        def close():
            if out is not None:
                out[1].write(out[2].flush())
                out[1].close()

        for part in bounded(batches, "payload"):
            columns = [part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first")]
            for page_id, url, payload, digest, first in zip(*columns):
                if out is None or written >= ARCHIVE_BYTES:
                    close()
                    system, path = _file(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = path, system.open_output_stream(path, compression=None), zlib.compressobj(_LEVEL, wbits=_GZIP)
                    done.append([f"{folder}/{path.rpartition('/')[2]}", 0])
                    written = 0
                data = record(page_id, url, payload, base64.b32encode(bytes.fromhex(digest)).decode(), first)
                out[1].write(out[2].compress(data))
                written += len(data)
                done[-1][1] += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["path", "records"])

    return stored(marked.select("page_id", "url", "payload", "digest", "first").mapInArrow(run, MANIFEST), "manifest")


def inflate(blocks):
    """The bytes of gzip members that follow one another, however few or many there are."""
    engine = None
    for block in blocks:
        while block:
            engine = engine or zlib.decompressobj(wbits=_GZIP)
            data = engine.decompress(block, _BLOCK)
            if data:
                yield data
            block = engine.unconsumed_tail
            if engine.eof:
                block, engine = engine.unused_data, None
            elif not block and not data:
                break
    if engine is not None:
        while data := engine.decompress(engine.unconsumed_tail, _BLOCK):
            yield data
        if not engine.eof:
            raise ValueError("the gzip stream is cut off")


_HEADER = re.compile(rb"(?mi)^(warc-type|warc-record-id|content-length):[ \t]*(.*?)[ \t]*\r?$")


def split_records(pieces):
    """(headers, iterator of the record's bytes) of a WARC stream, whose records are never held whole.

    The iterator of one record must be read before the next record is asked for.
    """
    buffer, pieces = bytearray(), iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            buffer.extend(piece)
        return piece is not None

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if len(buffer) > _MOST_HEADER or not more():
                if not buffer.strip():
                    return
                raise ValueError("a record has no end of its header")
        head = {k.lower().decode(): v.decode("utf-8", "replace") for k, v in _HEADER.findall(bytes(buffer[:end]))}
        if not buffer.startswith(b"WARC/") or not head.get("content-length", "").isdigit():
            raise ValueError("this is no WARC record")
        left = end + 4 + int(head["content-length"]) + 4

        def body():
            nonlocal left
            while left:
                if not buffer and not more():
                    raise ValueError("a record is cut off")
                out = bytes(buffer[:left])
                del buffer[:left]
                left -= len(out)
                yield out

        yield head, body()


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """The index (path, offset, length, record_type, record_id) of the archives rewritten, stored.

    Each archive is inflated once as a stream; every record becomes a gzip member of its own in a new
    file, next to which a sidecar file has a JSON line for each record.  Records of any size pass in
    blocks.  A damaged archive ends the job with an error.
    """
    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                system, path = _file(source)
                target = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                to_system, to_path = _file(target)
                to_system.create_dir(to_path.rpartition("/")[0], recursive=True)
                rows = []
                with system.open_input_stream(path, compression=None) as raw, to_system.open_output_stream(to_path, compression=None) as out, \
                        to_system.open_output_stream(f"{to_path}.index.jsonl", compression=None) as sidecar:
                    offset = 0
                    for head, body in split_records(inflate(iter(lambda: raw.read(_BLOCK), b""))):
                        member, length = zlib.compressobj(_LEVEL, wbits=_GZIP), 0
                        for piece in body:
                            packed = member.compress(piece)
                            out.write(packed)
                            length += len(packed)
                        packed = member.flush()
                        out.write(packed)
                        length += len(packed)
                        row = (target, offset, length, head.get("warc-type", ""), head.get("warc-record-id", ""))
                        sidecar.write(json.dumps(dict(zip(("offset", "length", "type", "id"), row[1:]))).encode() + b"\n")
                        rows.append(row)
                        offset += length
                        if len(rows) >= 10_000:
                            yield _index_batch(rows)
                            rows = []
                yield _index_batch(rows)

    # one file for each task as far as ranges go; at most 20000 tasks
    spread = manifest.repartitionByRange(max(1, min(manifest.count(), 20_000)), "path")
    return stored(spread.select("path").mapInArrow(run, INDEX), "index")


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                      names=["path", "offset", "length", "record_type", "record_id"])


def parse(data: bytes) -> tuple:
    """A record's type, id, URI, reference, digest, payload size and payload (null in a revisit)."""
    head, _, body = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = body[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?mi)^content-length:\s*(\d+)", http)[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload is not the one written")
    return (kind, fields["WARC-Record-ID"], fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"), digest, size,
            payload if kind == "response" else None)


def read_records(index: DataFrame) -> DataFrame:
    """The records of an index, each read at its offset (see RECORDS); digests of payloads are verified."""
    def run(batches):
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [c.split()[0] for c in RECORDS.split(", ")]
        open_path, source = None, None
        for batch in batches:
            batch = batch.take(pc.sort_indices(pa.table(batch.columns, names=batch.schema.names),
                                               [("path", "ascending"), ("offset", "ascending")]))
            rows, held = [], 0
            for path, offset, length in zip(*[batch.column(c).to_pylist() for c in ("path", "offset", "length")]):
                if path != open_path:
                    system, inner = _file(path)
                    open_path, source = path, system.open_input_file(inner)
                rows.append(parse(zlib.decompress(source.read_at(length, offset), wbits=_GZIP)))
                held += rows[-1][5]
                if held >= 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    size = index.agg(F.sum("length")).first()[0] or 0
    spread = index.repartitionByRange(max(1, int(np.ceil(size / READ_BYTES)), index.sparkSession.sparkContext.defaultParallelism), "path", "offset")
    return spread.select("path", "offset", "length").mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Pages written, normalised and read back: the records of the new archives (see RECORDS)."""
    spark = pages.sparkSession
    manifest = write_archives(pages, shared_dir(spark, "llm-warc"), min_revisit_bytes)
    return read_records(normalise(manifest, shared_dir(spark, "llm-warc-members")))
