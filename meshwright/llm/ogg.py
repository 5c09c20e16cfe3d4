"""Ogg as a column format: pages with checksums, packets by lacing values, logical streams, granule positions.

The writer cuts a payload into packets, deals them to logical streams in turn
and interleaves the streams' pages. The reader trusts nothing: it checks every
page's checksum and sequence number, puts packets together across pages, sorts
pages into their logical streams and takes times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, scratch

CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
IDENT = struct.Struct("<8sIII")  # magic, samples a second, stream number, streams
MAGIC = b"\x7fPCM8raw"
RATE, STREAMS, PACKET = 8000, 2, 2048
BLOCK = 64
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


class OggError(ValueError):
    """A page or packet that breaks the format."""


def checksum(page: bytes) -> int:
    """The Ogg CRC (polynomial 04c11db7, most significant bit first, from zero): zlib's, on mirrored bits."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


# -- writing --------------------------------------------------------------------------------------------------------
def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    head = HEADER.pack(CAPTURE, 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", checksum(head + body)) + head[26:] + body


def mux(payload: bytes, rate: int = RATE, streams: int = STREAMS, packet: int = PACKET) -> bytes:
    """A physical stream that holds ``payload`` as 8-bit samples in packets dealt to ``streams`` logical streams."""
    out = [_page(FIRST, 0, k + 1, 0, bytes([IDENT.size]), IDENT.pack(MAGIC, rate, k, streams)) for k in range(streams)]
    queues: list[list[bytes]] = []
    for k in range(streams):
        packets = [payload[at : at + packet] for at in range(k * packet, len(payload), streams * packet)] or [b""]
        lacing = bytearray()
        ends: dict[int, int] = {}  # segments so far -> samples so far, at each end of a packet
        done = 0
        for p in packets:
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            done += len(p)
            ends[len(lacing)] = done
        body, pages, pos = b"".join(packets), [], 0
        stops = sorted(ends)
        for number, at in enumerate(range(0, len(lacing), 255), 1):
            part = bytes(lacing[at : at + 255])
            size = sum(part)
            last = np.searchsorted(stops, at + len(part), side="right")
            inside = last and stops[last - 1] > at
            flags = (CONTINUED if at and lacing[at - 1] == 255 else 0) | (LAST if at + 255 >= len(lacing) else 0)
            pages.append(_page(flags, ends[stops[last - 1]] if inside else -1, k + 1, number, part, body[pos : pos + size]))
            pos += size
        queues.append(pages)
    for turn in range(max(map(len, queues))):
        out += [q[turn] for q in queues if turn < len(q)]
    return b"".join(out)


# -- reading --------------------------------------------------------------------------------------------------------
@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    times: list[int] = field(default_factory=list)  # granule position where known, else -1, of each packet
    pages: int = 0
    open: list[bytes] | None = None
    ended: bool = False


def demux(data: bytes) -> dict[int, Stream]:
    """The logical streams of a physical stream, by serial number; OggError if anything is wrong with them."""
    streams: dict[int, Stream] = {}
    at = 0
    if not data:
        raise OggError("no page")
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise OggError("the stream ends inside a page header")
        mark, version, flags, granule, serial, number, crc, segments = HEADER.unpack_from(data, at)
        if mark != CAPTURE or version:
            raise OggError(f"no page at byte {at}")
        body = at + HEADER.size + segments
        lacing = data[at + HEADER.size : body]
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("the stream ends inside a page")
        if checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != crc:
            raise OggError(f"wrong checksum of the page at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError(f"page {number} of stream {serial} is out of order")
        if bool(flags & CONTINUED) != (s.open is not None):
            raise OggError(f"page {number} of stream {serial} does not go on where the last one stopped")
        s.pages += 1
        parts, pos, done = s.open or [], body, 0
        for n in lacing:
            parts.append(data[pos : pos + n])
            pos += n
            if n < 255:
                s.packets.append(b"".join(parts))
                s.times.append(-1)
                parts, done = [], done + 1
        s.open = parts if lacing and lacing[-1] == 255 else None
        if done:
            s.times[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    for s in streams.values():
        if s.open is not None or not s.ended:
            raise OggError(f"stream {s.serial} has no end")
    return streams


@dataclass
class Media:
    payload: bytes
    rate: int
    streams: int
    packets: int
    pages: int
    seconds: float  # of the longest logical stream


def read(data: bytes) -> Media:
    """The samples that ``mux`` stored, with the timing that the granule positions state."""
    lanes: dict[int, Stream] = {}
    rate = count = 0
    for s in demux(data).values():
        if not s.packets or len(s.packets[0]) != IDENT.size or not s.packets[0].startswith(MAGIC):
            raise OggError(f"stream {s.serial} is not of 8-bit samples")
        _, rate, k, count = IDENT.unpack(s.packets[0])
        lanes[k] = s
        samples = 0
        for p, t in zip(s.packets[1:], s.times[1:], strict=True):
            samples += len(p)
            if t not in (-1, samples):
                raise OggError(f"stream {s.serial}: granule position {t} after {samples} samples")
    if sorted(lanes) != list(range(count)):
        raise OggError("a logical stream is missing")
    rows = [lanes[k].packets[1:] for k in range(count)]
    out = [row[turn] for turn in range(max(map(len, rows), default=0)) for row in rows if turn < len(row)]
    longest = max((max(s.times) for s in lanes.values()), default=0)
    return Media(b"".join(out), rate, count, sum(map(len, rows)), sum(s.pages for s in lanes.values()), longest / rate if rate else 0.0)


def feature(m: Media) -> str:
    """Level, roughness and timing of the samples, as text."""
    x = np.frombuffer(m.payload, np.uint8).astype(np.int64)
    n = len(x)
    mean, power = (int(x.sum()) * 1000 // n, int((x * x).sum()) * 1000 // n) if n else (0, 0)
    turns = int(np.count_nonzero(np.diff(x >= 128))) if n else 0
    return f"rate={m.rate};streams={m.streams};pages={m.pages};packets={m.packets};ms={round(1000 * m.seconds)};mean={mean};power={power};peak={int(x.max()) if n else 0};turns={turns}"


# -- the operator ---------------------------------------------------------------------------------------------------
def padded(text: bytes) -> bytes:
    return text + bytes(max(BLOCK, -(-len(text) // BLOCK) * BLOCK) - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media``: each text's bytes, padded to a positive multiple of 64, as an Ogg stream in the shared folder.

    Null and empty texts are 64 zero bytes. Ids may be null or repeat: every row
    has its own media; an empty table gives an empty one; a text of any length is
    stored whole. Other columns are ignored, whatever their names. Equal texts have
    equal media.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([mux(padded(t)) for t in texts], pa.binary())], names=["id", "n_bytes", "media"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    return scratch(rows.transform(arrow_map, run, "id long, n_bytes long, media binary"), "media")


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digest(media: DataFrame, strict: bool = True) -> DataFrame:
    """What the stored media hold, read back: sizes, hashes and features of each row of ``to_media``.

    A damaged stream raises OggError; with ``strict=False`` its row has an ``error``
    instead of what can't be told, a column that is null for whole streams. A null
    stream is an empty one, which is damaged. No rows give an empty table.
    """
    names = [x.split()[0] for x in DIGEST.split(", ")] + ([] if strict else ["error"])
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())[: len(names) - 2]

    def told(data: bytes) -> tuple:
        size = (len(data), hashlib.sha256(data).hexdigest())
        try:
            m = read(data)
        except OggError as e:
            if strict:
                raise
            return None, None, None, *size, None, str(e)
        return (len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-BLOCK:]), *size, feature(m), None)[: len(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "media"):
            out = [told(data or b"") for data in piece.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True))], names=names)

    return media.transform(arrow_map, run, DIGEST if strict else f"{DIGEST}, error string")
