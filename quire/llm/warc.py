"""A WARC writer with dictionary-compressed records, and its reader.

An archive is a run of Zstandard frames. The first is a skippable frame (magic 0x184D2A5D)
that holds a dictionary, itself compressed; each further frame is one WARC record, compressed
on its own with that dictionary, so a record can be read by its offset. The dictionary is
trained on records of the same archive. Records whose payload another record already has are
written as `revisit`: HTTP headers without the payload, and a reference to the first.

Archives are rows (archive, content) of a table in the shared folder, written by Spark's committed
writer, so a lost task leaves no half-written archive; `export` puts them into plain files.

Cases: a null payload is the empty payload and is deduplicated like any other; a null or
unprintable url is written percent-encoded, and one without text as a urn; of equal payloads with
equal smallest ids (repeated rows) all are responses; a null id is written as `-`, sorts last and is
read back as null; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import written

SKIPPABLE = 0x184D2A5D
DATE = "1970-01-01T00:00:00Z"  # records carry no fetch time
LEVEL = 3
DICT_BYTES = 65_536
TRAIN_RECORDS = 400  # records of an archive, evenly spaced, that its dictionary is trained on
ARCHIVE_BYTES = 16 << 20  # uncompressed, after which an archive is closed
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class Record:
    page_id: int | None
    url: str
    kind: str
    payload: bytes | None  # None for a revisit
    payload_bytes: int
    digest: str
    refers_to: int | None = None


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None, page_id: int | None) -> str:
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", (url or "").strip())
    return clean or f"urn:page:{'-' if page_id is None else page_id}"


def _record_id(page_id: int | None, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}:{page_id}')}>"


def encode_record(r: Record) -> bytes:
    """One record in WARC/1.1 form."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = http + (r.payload or b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {r.kind}",
        f"WARC-Record-ID: {_record_id(r.page_id, r.kind)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_uri(r.url, r.page_id)}",
        f"WARC-Page-ID: {'-' if r.page_id is None else r.page_id}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{r.digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if r.kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(r.refers_to, 'response')}", f"WARC-Refers-To-Page-ID: {r.refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(data: bytes) -> Record:
    """The record of encode_record's form; its block digest and, of a response, its payload digest are checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    h = dict(x.split(": ", 1) for x in lines)
    n = int(h["Content-Length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    if h["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("a record's block digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    kind, known = h["WARC-Type"], h["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda x: None if x in (None, "-", "None") else int(x)
    if kind == "revisit":
        return Record(number(h["WARC-Page-ID"]), h["WARC-Target-URI"], kind, None, int(fields["Content-Length"]), known, number(h["WARC-Refers-To-Page-ID"]))
    own = digest(payload)
    if own != known:
        raise ValueError("a record's payload digest is wrong")
    return Record(number(h["WARC-Page-ID"]), h["WARC-Target-URI"], kind, payload, len(payload), own)


def encode_archive(records: list[bytes]) -> bytes:
    """Records as one archive: the dictionary's skippable frame, then a frame each."""
    some = records[:: max(1, len(records) // TRAIN_RECORDS)]
    size = min(DICT_BYTES, sum(map(len, some)) // 8)
    try:
        trained = zstandard.train_dictionary(size, some).as_bytes() if len(some) >= 8 and size >= 1024 else b""
    except zstandard.ZstdError:  # too little or too uniform text
        trained = b""
    if not trained:
        trained = some[0][:4096] if some else b""
    kind = zstandard.DICT_TYPE_AUTO
    frame = zstandard.ZstdCompressor(level=LEVEL).compress(trained)
    head = SKIPPABLE.to_bytes(4, "little") + len(frame).to_bytes(4, "little") + frame
    d = zstandard.ZstdCompressionDict(trained, dict_type=kind)
    d.precompute_compress(level=LEVEL)
    one = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=True, write_checksum=True)
    return b"".join([head, *map(one.compress, records)])


def decode_archive(data: bytes) -> Iterator[bytes]:
    """The records of an archive, frame by frame."""
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    n = int.from_bytes(data[4:8], "little")
    d = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + n]), dict_type=zstandard.DICT_TYPE_AUTO)
    one = zstandard.ZstdDecompressor(dict_data=d)
    rest = memoryview(data)[8 + n :]
    while len(rest):
        object_ = one.decompressobj()
        size = zstandard.frame_content_size(rest[:18])
        out = b""
        at = 0
        step = 1 << 16 if size < 0 else max(1 << 12, size // 2)
        while not object_.eof:
            if at >= len(rest):
                raise ValueError("an archive ends within a record")
            out += object_.decompress(rest[at : at + step])
            at += step
        rest = rest[min(at, len(rest)) - len(object_.unused_data) :]
        yield out


def write(pages: DataFrame, path: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages (page_id, url, html) as archives; gives the table (archive, content).

    Of payloads of at least least_bytes, only the one with the smallest page_id is stored in full.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    same = ["sha", "n", "hash"]  # texts made to share their SHA-1 differ in the other hash
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("sha"), F.length(payload).cast("bigint").alias("n"), F.xxhash64(payload).alias("hash"))
    first = rows.where(F.col("n") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    shared = first.where(F.col("copies") > 1).select(*same, "first")
    whole = rows.join(shared, same, "left")
    again = F.coalesce((F.col("n") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    dealt = whole.select("page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "sha", "n", F.when(again, F.col("first")).alias("refers_to"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            content = encode_archive(records)
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], ["archive", "content"])

        for batch in batches:
            for page_id, url, body, sha, n, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = "response" if to is None else "revisit"
                d = base64.b32encode(bytes.fromhex(sha)).decode()
                records.append(encode_record(Record(page_id, url, kind, body if to is None else None, n, d, to)))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    records, size = [], 0
        if records:
            yield close()

    archives = dealt.mapInArrow(build, "archive string, content binary")
    if path is None:
        return written(archives, "archives")
    archives.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


RECORD = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (content); with payloads=False their payloads are checked, but not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
        )
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                size = 0
                for data in decode_archive(content.as_py()):
                    r = decode_record(data)
                    out.append((r.page_id, r.url, r.kind, r.payload if payloads else None, r.payload_bytes, r.digest, r.refers_to))
                    size += len(data)
                    if size > ARCHIVE_BYTES or len(out) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out, size = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return archives.select("content").mapInArrow(run, RECORD)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Put archives into plain files of a folder that all executors mount; gives their names and sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            names, sizes = batch["archive"].to_pylist(), []
            for name, content in zip(names, batch["content"].to_pylist(), strict=True):
                part = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}")  # a repeated task writes the same file again
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.array(sizes, np.int64))], ["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes bigint")
