"""WARC archives: one gzip member per record, written by all tasks side by side and read back sequentially.

Of records with equal payloads one is a response, the others are revisits that name it; which one follows from the
payloads' SHA-1 and length, with one row per payload combined before its shuffle. Archives are plain .warc.gz content,
written through Spark's own writer and committer, so that they go to whatever store the shared folder is on and a retried
task leaves no half-written file. A row for the writer is as many members as fill CHUNK bytes, or one that is larger, and
a file holds ROWS of them: so files are bounded by bytes. The writer ends every row with a zero byte, which takes the place
of the last byte of the last member's length field; that is zero for records under 16 MB, and behind a larger one an empty
member follows.

The reader decompresses a file step by step, parses each record's head, frames its block by Content-Length, checks that
the member ends where the record does, and verifies block and payload digests. It holds one file of compressed records,
as Spark hands it over, and one record that is decompressed.

Defined cases: a null html is an empty payload; a null url leaves its header out; null page_ids sort below all others
and are read back as null; rows of equal page_id and payload are all responses if that id is the largest; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import checkpointed, join_hot, shared_dir

#: Compressed bytes of a row for the writer, and rows of a file.
CHUNK, ROWS = 4 << 20, 16
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
STEP = 1 << 16
#: Payloads that occur more than once and are broadcast (36 bytes each) at most.
NARROW = 200_000


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, response: bool, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if response else head
    name = lambda x: f"<urn:x-page:{'' if x is None else x}>"
    lines = ["WARC/1.0", f"WARC-Type: {'response' if response else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if not response:
        lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """data as one gzip member with an empty time stamp, so that reruns write the same bytes."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def read_members(archive: memoryview) -> Iterator[bytes]:
    """The uncompressed content of each gzip member, decompressed step by step; empty members and zero bytes between members are skipped."""
    at, end = 0, len(archive)
    while at < end:
        if archive[at] == 0:
            at += 1
            continue
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            if at >= end:
                raise ValueError("the archive ends within a gzip member")
            piece = archive[at : at + STEP]
            parts.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        if data := b"".join(parts):
            yield data


def parse(data: bytes) -> dict:
    """The fields of one record, with both digests verified; a record that isn't framed as it says raises ValueError."""
    head, found, _ = data.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"WARC/"):
        raise ValueError("no WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
    length = int(fields["content-length"])
    block, rest = data[len(head) + 4 : len(head) + 4 + length], data[len(head) + 4 + length :]
    if len(block) != length or rest != b"\r\n\r\n":
        raise ValueError("the record's length isn't its Content-Length")
    if fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError("block digest mismatch")
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    if kind == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError("payload digest or length mismatch")
    number = lambda x: int(m[1]) if (m := re.match(r"<urn:x-page:(-?\d+)>$", x or "")) else None
    return {
        "page_id": number(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "payload_bytes": size, "payload_digest": said, "record_type": kind,
        "refers_to": number(fields.get("warc-refers-to")), "payload": payload if kind == "response" else None,
    }


def plan(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha, response, refers_to): which records are responses and what the others revisit."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    # Only payloads that occur more than once take part in the join; while they are few, no payload is shuffled.
    keys = rows.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    first = checkpointed(keys.filter("n > 1"))
    few = first.limit(NARROW + 1).count() <= NARROW
    joined = rows.join(F.broadcast(first.drop("n")), ["sha", "size"], "left") if few else join_hot(rows, first, ["sha", "size"], "n", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "sha", (~revisit).alias("response"), F.when(revisit, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", chunk: int = CHUNK, rows: int = ROWS) -> None:
    """Write a record per row of pages into .warc.gz content under folder, at most so many rows of chunk bytes a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def row() -> pa.RecordBatch:
            if held[-1][-1]:
                held.append(member(b""))
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-1]], pa.binary())], ["members"])

        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, payload, sha, response, refers_to = (batch.column(c)[k].as_py() for c in ("page_id", "url", "payload", "sha", "response", "refers_to"))
                held.append(member(record(page_id, url, payload, base64.b32encode(sha).decode(), response, refers_to, date)))
                size += len(held[-1])
                if size >= chunk:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    members = plan(pages, least_bytes).mapInArrow(run, "members binary")
    members.select(F.col("members").cast("string")).write.option("lineSep", "\0").option("maxRecordsPerFile", rows).text(folder)


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (path, content), as Spark's binaryFile source gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for content in batch.column(0):
                held = []
                for data in read_members(memoryview(content.as_buffer())):
                    held.append(parse(data))
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema)

    return archives.select("content").mapInArrow(run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write pages as archives into folder (a new one in the shared folder) and read them back."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, folder, least_bytes)
    return read(spark.read.format("binaryFile").load(folder))
