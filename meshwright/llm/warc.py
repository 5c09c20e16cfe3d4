"""WARC archives: write one gzip member per record, read them back one member at a time.

An archive is a byte string of bounded size, held as a row of a table in the
shared folder (``archive``, ``data``), so executors never touch a local file. A
real ``.warc.gz`` file reads the same way through ``read_files``. The reader walks
the bytes in order: it inflates in steps, frames a record by its Content-Length,
checks that the member ends with it, and verifies the digest of what it read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWEST, arrow_map, key, pieces, scratch

ARCHIVE_BYTES = 8 << 20
STEP = 1 << 16
RECORD = "warc_type string, record_id string, target_uri string, headers string, payload binary, payload_length long, payload_digest string, refers_to string, error string"
_TYPES = [("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("headers", pa.string()), ("payload", pa.binary()), ("payload_length", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("error", pa.string())]


class WarcError(ValueError):
    """A record that breaks the format or its own digest."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# -- writing --------------------------------------------------------------------------------------------------------
def _clean(value: str) -> str:
    """A header value must stay on its line."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def encode_record(record_id: str, payload: bytes, payload_digest: str, uri: str | None = None, refers_to: str | None = None, level: int = 1) -> bytes:
    """A response record, or the revisit record of a payload that ``refers_to`` holds, as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <urn:page:{record_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {_clean(uri)}")
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """``(record_id string, uri string, payload binary, payload_digest string, refers_to string)`` to ``(archive long, data binary)``.

    ``payload_digest`` is the SHA-1 in hex.
    Each task packs its records into archives of about ``archive_bytes``; one
    larger record is an archive of its own. A revisit needs only the length of its
    payload, which its HTTP head states.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n = [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([b"".join(held)], pa.binary())], names=["archive", "data"])

        for piece in pieces(batches, "payload"):
            for record_id, uri, payload, payload_digest, refers in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                member = encode_record(record_id, payload or b"", base64.b32encode(bytes.fromhex(payload_digest)).decode(), uri, refers)
                if held and size + len(member) > archive_bytes:
                    yield out()
                    held, size, n = [], 0, n + 1
                held.append(member)
                size += len(member)
        if held:
            yield out()

    return records.select("record_id", "uri", "payload", "payload_digest", "refers_to").transform(arrow_map, run, "archive long, data binary")


# -- reading --------------------------------------------------------------------------------------------------------
def _members(data: bytes) -> Iterator[tuple[bytes, str | None]]:
    """The inflated gzip members of an archive, with what is wrong with the last one if it can't be read to its end."""
    at = 0
    view = memoryview(data)
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        try:
            while not z.eof and at < len(data):
                step = view[at : at + STEP]
                parts.append(z.decompress(step))
                at += len(step) - len(z.unused_data)
            yield b"".join(parts), None if z.eof else "the archive ends inside a member"
        except zlib.error as e:
            yield b"".join(parts), f"bad gzip member: {e}"
            return


def parse_record(member: bytes) -> dict:
    """The record in a member; WarcError if its framing or a digest is wrong."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise WarcError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    try:
        length = int(fields["content-length"])
    except (KeyError, ValueError):
        raise WarcError("no Content-Length") from None
    block = rest[:length]
    if len(block) < length or rest[length:] != b"\r\n\r\n":
        raise WarcError("the record is not as long as its Content-Length")
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{digest(block)}":
        raise WarcError("the block digest differs")
    kind, payload, n = fields.get("warc-type", ""), block, length
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        m = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
        n = int(m[1]) if m else len(payload)
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind == "revisit":
        payload = None
    elif stated and stated != digest(payload) or n != len(payload):
        raise WarcError("the payload digest differs")
    return {"warc_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "headers": "\n".join(lines[1:]), "payload": payload, "payload_length": n, "payload_digest": stated, "refers_to": fields.get("warc-refers-to"), "error": None}


def read_archives(archives: DataFrame, column: str = "data", strict: bool = True) -> DataFrame:
    """One row a record of every archive, in its order. A bad record raises, or with ``strict=False`` has its ``error`` set."""

    def rows(data: bytes) -> Iterator[dict]:
        for member, wrong in _members(data):
            try:
                if wrong:
                    raise WarcError(wrong)
                yield parse_record(member)
            except WarcError as e:
                if strict:
                    raise
                yield {n: None for n, _ in _TYPES} | {"error": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                held, size = [], 0
                for row in rows(batch.column(0)[k].as_py() or b""):
                    held.append(row)
                    size += len(row["payload"] or b"") + 500
                    if size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, pa.schema(_TYPES))
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, pa.schema(_TYPES))

    return archives.select(column).transform(arrow_map, run, RECORD)


def read_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The records of ``.warc.gz`` archives compressed by record, wherever Spark can read files.

    An archive is read as one value, which Spark holds up to 2 GB; archives of the
    usual 1 GB need executors with the memory for it.
    """
    return read_archives(spark.read.format("binaryFile").load(path), "content", strict)


# -- the operator ---------------------------------------------------------------------------------------------------
def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record a page into archives, a revisit where a page of larger id has an equal payload.

    Payloads are equal if their SHA-256 is; the digest in the record is SHA-1, as the
    format has it. A null html is an empty payload; empty payloads are equal to each
    other; a page of any length is one record. A
    null id counts below every id and reads back as null; rows that tie on the
    largest id of a payload are all responses. An empty table gives no archive.
    Other columns are ignored. Returns the archives, stored in the shared folder.
    """
    html = F.coalesce(pages[html_col].cast("string"), F.lit("")).cast("binary")
    rows = pages.select(key(pages[id_col], LOWEST).alias("id"), pages[url_col].cast("string").alias("uri"), html.alias("payload"), F.sha1(html).alias("sha"), F.unhex(F.sha2(html, 256)).alias("same"))
    digests = scratch(rows.select("id", "same").distinct(), "digests")
    repeated = scratch(digests.groupBy("same").agg(F.max("id").alias("response"), F.count("*").alias("n")).filter("n > 1").select("same", "response"), "payloads")
    revisits = scratch(digests.join(repeated, "same").filter("id <> response"), "revisits")
    name = lambda c: F.when(c == LOWEST, F.lit("none")).otherwise(c.cast("string"))
    records = rows.join(revisits, ["id", "same"], "left").select(name(F.col("id")).alias("record_id"), "uri", "payload", F.col("sha").alias("payload_digest"), F.when(F.col("response").isNotNull(), name(F.col("response"))).alias("refers_to"))
    return scratch(write_archives(records), "warc")


def page_records(archives: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of archives that ``archive_pages`` wrote."""
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")
    r = read_archives(archives)
    return r.select(number(F.col("record_id")).alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", F.col("warc_type").alias("record_type"), number(F.col("refers_to")).alias("refers_to"))


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), d AS (
  SELECT page_id, payload_bytes, h, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      CAST((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) FOR i IN range(32)], '') AS payload_digest,
      max(page_id) OVER (PARTITION BY h) AS response
  FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""
