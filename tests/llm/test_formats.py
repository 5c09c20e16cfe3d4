"""WARC and Ogg: round trips, and errors for whatever is damaged."""

import gzip
import hashlib
import random

import pytest

from meshwright.llm import ogg, warc


def crc_by_bits(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = ((crc << 1) ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


@pytest.mark.parametrize("n", [0, 1, 63, 64, 2047, 2048, 2049, 65025, 70000, 300000])
def test_ogg_round_trip(n):
    payload = ogg.padded(random.Random(n).randbytes(n))
    data = ogg.mux(payload)
    m = ogg.read(data)
    assert m.payload == payload and m.streams == 2 and len(payload) % 64 == 0 and len(payload) >= 64
    lanes = ogg.demux(data)
    assert sorted(lanes) == [1, 2] and lanes[1].times[-1] + lanes[2].times[-1] == len(payload)
    other = ogg.mux(payload, rate=100, streams=3, packet=255)
    assert ogg.read(other).payload == payload and "rate=100" in ogg.feature(ogg.read(other))


def test_ogg_checksum_is_the_format_s():
    data = random.Random(1).randbytes(500)
    assert ogg.checksum(data) == crc_by_bits(data)
    page = ogg.mux(b"\0" * 64)[:48]
    assert page[:4] == b"OggS" and int.from_bytes(page[22:26], "little") == crc_by_bits(page[:22] + b"\0\0\0\0" + page[26:])


def test_ogg_damage_is_seen():
    data = ogg.mux(random.Random(2).randbytes(200000))
    for at in (0, 5, 30, 3000, len(data) - 1):
        with pytest.raises(ogg.OggError):
            ogg.read(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
    for bad in (data[:-1], data[:-70000], data[48:], data + data[-100:]):
        with pytest.raises(ogg.OggError):
            ogg.read(bad)


def test_warc_record_round_trip():
    html = "<p>é\r\n\r\nx</p>".encode()
    member = warc.encode_record("7", html, warc.digest(html), "http://a/\r\nX: y")
    r = warc.parse_record(gzip.decompress(member))
    assert r["payload"] == html and r["record_id"] == "<urn:page:7>" and r["target_uri"] == "http://a/%0D%0AX: y" and r["payload_length"] == len(html)
    again = warc.parse_record(gzip.decompress(warc.encode_record("8", html, warc.digest(html), None, "7")))
    assert again["warc_type"] == "revisit" and again["payload"] is None and again["payload_length"] == len(html) and again["refers_to"] == "<urn:page:7>"


def test_warc_damage_is_seen(spark):
    html = b"hello " * 50
    good = gzip.decompress(warc.encode_record("1", html, warc.digest(html)))
    for bad in (good[:-1], good.replace(b"hello", b"hellO", 1), good + b"x", b"junk", good.replace(b"Content-Length", b"Content-Lengxx", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)
    wrong = warc.encode_record("2", html, "A" * 32)
    archive = warc.encode_record("1", html, warc.digest(html)) + wrong + warc.encode_record("3", html, warc.digest(html))
    rows = warc.read_archives(spark.createDataFrame([(bytearray(archive),), (bytearray(archive[:-5]),), (None,)], "data binary"), strict=False).collect()
    assert [r["error"] is None for r in rows] == [True, False, True, True, False, False]
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark.createDataFrame([(bytearray(archive),)], "data binary")).collect()


def test_warc_files_read_the_same(spark, tmp_path):
    html = b"x" * 100000
    (tmp_path / "a.warc.gz").write_bytes(b"".join(warc.encode_record(str(k), html + bytes([k]), warc.digest(html + bytes([k]))) for k in range(5)))
    rows = warc.read_files(spark, f"file://{tmp_path}/*.warc.gz").collect()
    assert [r["record_id"] for r in rows] == [f"<urn:page:{k}>" for k in range(5)] and all(hashlib.sha1(r["payload"]).digest() for r in rows)


def test_equal_payloads_have_one_response(spark):
    pages = spark.createDataFrame([(1, "u", "a"), (5, "u", "a"), (3, None, "a"), (2, "u", None), (4, "u", ""), (None, "u", "a"), (6, "u", "b")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(warc.archive_pages(pages)).collect()}
    assert got == {5: ("response", None, 1), 1: ("revisit", 5, 1), 3: ("revisit", 5, 1), None: ("revisit", 5, 1), 4: ("response", None, 0), 2: ("revisit", 4, 0), 6: ("response", None, 1)}
