"""WARC archives compressed with Zstandard: writer and reader.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the
dictionary; then every record is one frame.  The reader loads the dictionary,
walks from frame to frame by the block headers, decodes one frame per record
and validates headers, lengths and digests.

Scale: archives are bounded by `archive_bytes` of records and made where the
pages lie.  They are written by Spark's own text writer, one archive a file, so
they reach any file system that Spark does and survive lost executors; copies
are found by digest, and only digests that occur twice meet in a join.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stash

#: Frame magics of the WARC and Zstandard formats.
DICTIONARY, PADDING, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
#: Fixed value: the profile of revisit records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Record(NamedTuple):
    """What an archive says of a page."""

    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(body))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> Record:
    """A record of decoded bytes; raises ValueError where headers, lengths or digests don't hold."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    ident = lambda x: None if x in (None, "<urn:page:>") else int(x[10:-1])
    if kind == "response":
        if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("the payload doesn't fit its length or digest")
        return Record(ident(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, None, size, digest, payload)
    if kind != "revisit" or payload:
        raise ValueError(f"a {kind} with a payload")
    return Record(ident(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, ident(fields["WARC-Refers-To"]), size, digest, None)


def dictionary(samples: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary trained on an archive's first records; None if they are too few."""
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8) if len(samples) >= 16 else None
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], dict_bytes: int = 16_384, sample_bytes: int = 400_000, level: int = 3) -> bytes:
    """The records as one archive; it ends with a skippable frame that holds a line end."""
    samples, n = [], 0
    for r in records:
        if n >= sample_bytes:
            break
        samples.append(r[:20_000])
        n += len(samples[-1])
    d = dictionary(samples, dict_bytes)
    c = zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=True)
    head = [] if d is None else [struct.pack("<II", DICTIONARY, len(d.as_bytes())), d.as_bytes()]
    return b"".join([*head, *map(c.compress, records), struct.pack("<II", PADDING, 1), b"\n"])


def frames(data: bytes) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame or, of skippable ones, content) of every frame."""
    view, at = memoryview(data), 0
    while at < len(view):
        magic, size = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at + 8 + size > len(view):
                raise ValueError("a skippable frame is cut off")
            yield magic, view[at + 8 : at + 8 + size]
            at += 8 + size
        elif magic == FRAME:
            end, last = at + zstandard.frame_header_size(bytes(view[at : at + 18])), 0
            while not last:
                if end + 3 > len(view):
                    raise ValueError("a frame is cut off")
                block = view[end] | view[end + 1] << 8 | view[end + 2] << 16
                last, kind, size = block & 1, block >> 1 & 3, block >> 3
                end += 3 + (1 if kind == 1 else size)
            end += 4 if view[at + 4] & 4 else 0
            if end > len(view):
                raise ValueError("a frame is cut off")
            yield magic, view[at:end]
            at = end
        else:
            raise ValueError("no frame where one should begin")


def records(data: bytes) -> Iterator[Record]:
    """The records of an archive, or of several behind one another."""
    d = zstandard.ZstdDecompressor()
    for magic, frame in frames(data):
        if magic == DICTIONARY:
            d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(frame)))
        elif magic == FRAME:
            yield parse(d.decompress(frame))


def plan(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, url, html, digest, size and refers_to: of equal payloads of at least
    `least` bytes the largest page_id is the response that the others refer to.

    Rows that repeat the largest page_id are all responses; a null page_id is the
    least.  The digests that occur twice are written first, so that a join that is too
    large to be broadcast is one of two plain shuffles, whose hot digests Spark splits.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    copies = p.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where(F.col("n") > 1)
    j = p.join(stash(copies.select("digest", "first"), "copies"), "digest", "left")
    other = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return j.select("page_id", "url", "html", "digest", "size", F.when(other, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = 1000, archive_bytes: int = 8_000_000) -> None:
    """Writes a record per row of pages (page_id, url, html) into archives below path.

    Null html: an empty payload; null url or page_id: left out of the header.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def made():
            return pa.RecordBatch.from_arrays([pa.array([archive(held)[:-1]], pa.binary())], ["value"])  # the writer ends the line

        for b in batches:
            for page_id, url, html, digest, size, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(record(page_id, url, b"" if refers is not None else html.encode(), size, digest, refers))
                n += len(held[-1])
                if n >= archive_bytes:
                    yield made()
                    held, n = [], 0
        if held:
            yield made()

    out = plan(pages, least).mapInArrow(run, "value binary")
    out.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def read(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row per record of the archives below path: page_id, url, record_type,
    refers_to, payload_bytes, payload_digest and, if asked for, payload."""
    names = [x for x in Record._fields if payload or x != "payload"]
    kinds = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long", "payload_digest": "string", "payload": "binary"}
    arrow = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                held: list[Record] = []

                def made(rows):
                    return pa.RecordBatch.from_arrays([pa.array([getattr(r, x) for r in rows], arrow[kinds[x]]) for x in names], names)

                for r in records(data.as_py()):
                    held.append(r if payload else r._replace(payload=None))
                    if len(held) >= 1000:
                        yield made(held)
                        held = []
                if held:
                    yield made(held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, ", ".join(f"{x} {kinds[x]}" for x in names))
