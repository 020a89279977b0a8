"""WARC archives: records are written with an index first, and read back by coalesced byte ranges.

Each task writes one archive of gzip members, a record each, into the shared folder under a name of its own, so that a repeated task never
writes into another's file; the index rows of the attempt that counts name the file that counts. The index has offset, length, URL and
digest per record. To read, index rows are put in order of file and offset, and ranges that lie close together become one read.

Of records with equal payloads of at least LEAST_BYTES the one with the smallest page_id holds the payload; the others are revisits, which hold the HTTP
header alone. Defined cases: a null html is an empty payload; rows without page_id are responses and are not referred to; rows of one page_id
and payload are alike; a null url is left out; an empty table writes nothing; other columns are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import drop_at_exit, join_hot, join_some, parts_of, shared_folder, small_batches, stored, text_bytes, tidy

LEAST_BYTES = 100
#: Ranges at most this far apart are read together, up to this much at once.
GAP, MOST_READ = 64 << 10, 8 << 20
INDEX = "page_id long, url string, file string, offset long, length long, payload_digest string, record_type string"
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed as a member of its own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(lines).encode() + block + b"\r\n\r\n") + c.flush()


def headers(raw: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in raw.decode().split("\r\n")[1:])}


def parse(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a compressed record. A response's digest is taken from its payload and must be the one that it states."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = headers(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = fields["warc-payload-digest"].removeprefix("sha256:")
    own = lambda name: int(x) if (x := fields[name].split(":")[2]) else None
    if fields["warc-type"] == "revisit":
        return own("warc-record-id"), int(headers(http)["content-length"]), stated, "revisit", own("warc-refers-to")
    digest = hashlib.sha256(payload).hexdigest()
    if digest != stated:
        raise ValueError(f"the payload of {fields['warc-record-id']} isn't what its digest says")
    return own("warc-record-id"), len(payload), digest, "response", None


def open_store(uri: str):
    """The file system of the folder and the path in it; any that Arrow can reach."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}")


def writing(folder: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        at = 0
        with contextlib.ExitStack() as files:  # closed whether the task ends or fails
            out = None
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    out = out or files.enter_context(store.open_output_stream(posixpath.join(path, name), compression=None))
                    payload = html.encode()
                    digest = hashlib.sha256(payload).hexdigest()
                    member = record(page_id, url, payload, digest, refers_to)
                    out.write(member)
                    rows.append((page_id, url, name, at, len(member), digest, "response" if refers_to is None else "revisit"))
                    at += len(member)
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["page_id", "url", "file", "offset", "length", "payload_digest", "record_type"])

    return of


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int, most: int) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of ranges, in order, that one read covers."""
    run: list[tuple[str, int, int]] = []
    for file, offset, length in ranges:
        if run and (file != run[0][0] or offset > run[-1][1] + run[-1][2] + gap or offset + length - run[0][1] > most):
            yield run
            run = []
        run.append((file, offset, length))
    if run:
        yield run


def reading(folder: str, gap: int, most: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = open_store(folder)
        now = opened = None
        ranges = (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
        for run in coalesced(ranges, gap, most):
            file, first, _ = run[0]
            if file != now:
                now, opened = file, store.open_input_file(posixpath.join(path, file))
            raw = opened.read_at(run[-1][1] + run[-1][2] - first, first)
            rows = [parse(raw[offset - first : offset - first + length]) for _, offset, length in run]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return of


def write(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the archives and returns their index, which is stored. Pages stay in the tasks that read them while the list of revisits is short enough to be sent to all."""
    p = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.unhex(F.sha2(F.encode("html", "utf-8"), 256)))
    ids = p.where((F.octet_length("html") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    held = stored(ids.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last"))
    refers = stored(join_hot(ids, held.select("digest", "first"), "digest", counts=held.select("digest", "n")).where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct())
    told = join_some(p, refers, ["page_id", "digest"], "left", parts_of(pages.sparkSession, text_bytes(p, "html")))
    return stored(told.select("page_id", "url", "html", "refers_to").mapInArrow(tidy(writing(folder)), INDEX))


def read(index: DataFrame, folder: str, gap: int = GAP, most: int = MOST_READ) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that the index rows name."""
    size = index.agg(F.sum("length")).first()[0] or 0
    return index.select("file", "offset", "length").repartitionByRange(parts_of(index.sparkSession, size), "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(tidy(reading(folder, gap, most)), READ)


def archive(pages: DataFrame) -> DataFrame:
    """Writes all pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = shared_folder(spark)
    drop_at_exit(spark, folder)
    return read(write(pages, folder), folder)
