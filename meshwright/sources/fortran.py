"""Unformatted Fortran files: records framed by their length, read wherever Spark can read files."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workers import reachable

TITLE = 80


def records(data: bytes, big_endian: bool = True) -> Iterator[bytes]:
    """The payloads of all records; a frame that does not close as it opened raises."""
    f = struct.Struct(">i" if big_endian else "<i")
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise ValueError("the file ends inside a record's frame")
        (n,) = f.unpack_from(data, at)
        if n < 0 or at + 8 + n > len(data) or f.unpack_from(data, at + 4 + n)[0] != n:
            raise ValueError(f"bad record at byte {at}")
        yield data[at + 4 : at + 4 + n]
        at += 8 + n


def write_record(payload: bytes, big_endian: bool = True) -> bytes:
    n = struct.pack(">i" if big_endian else "<i", len(payload))
    return n + payload + n


def shape_of(n: int, shapes: dict[int, tuple[int, int]] | None = None) -> tuple[int, int]:
    """(jm, im) of a global field of n values: a known one, else twice as many columns as rows."""
    if shapes and n in shapes:
        return shapes[n]
    jm = round((n / 2) ** 0.5)
    if 2 * jm * jm != n:
        raise ValueError(f"{n} values are not a global field of a known shape")
    return jm, 2 * jm


# Sizes of the fields of the named grids that are not twice as wide as high.
SHAPES = {288 * 180: (180, 288), 144 * 90: (90, 144), 72 * 46: (46, 72)}


def read_titled(spark: SparkSession, path: str, dtype: str = "f4", big_endian: bool = True) -> DataFrame:
    """``(path, record, title, j, i, value)`` of files of titled fields: 80 characters, then the values, row by row."""
    kind = np.dtype((">" if big_endian else "<") + dtype)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                for k, rec in enumerate(records(content, big_endian)):
                    values = np.frombuffer(rec[TITLE:], kind).astype("f8")
                    jm, im = shape_of(len(values), SHAPES)
                    j, i = np.divmod(np.arange(jm * im), im)
                    yield pd.DataFrame({"path": name, "record": k, "title": rec[:TITLE].decode("latin-1").rstrip(), "j": j.astype("i4"), "i": i.astype("i4"), "value": values})

    reachable(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, record int, title string, j int, i int, value double")


def read_untitled(spark: SparkSession, path: str, im: int, jm: int, names: list[str], dtype: str = "i2", big_endian: bool = True) -> DataFrame:
    """``(j, i, *names)`` of a file with one record for each name."""
    kind = np.dtype((">" if big_endian else "<") + dtype)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in pdf["content"]:
                fields = [np.frombuffer(r, kind).astype("f8") for r in records(content, big_endian)]
                if len(fields) != len(names) or any(len(f) != im * jm for f in fields):
                    raise ValueError(f"expected {len(names)} records of {im} x {jm} values")
                for j in range(0, jm, max(1, (1 << 20) // im)):
                    own = slice(j * im, min(jm, j + max(1, (1 << 20) // im)) * im)
                    at = np.arange(own.start, own.stop)
                    yield pd.DataFrame({"j": (at // im).astype("i4"), "i": (at % im).astype("i4")} | {n: f[own] for n, f in zip(names, fields, strict=True)})

    reachable(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "j int, i int, " + ", ".join(f"{n} double" for n in names))


def title_columns(title: Column) -> list[Column]:
    """name, description, units, source of a title ``name: description (units)  source``."""
    head = F.regexp_extract(title, r"^([^:(]*):", 1)
    rest = F.regexp_replace(title, r"^[^:(]*:", "")
    desc = F.regexp_extract(rest, r"^\s*([^(]*?)\s*(?:\(|\s{2,}|$)", 1)
    unit = F.regexp_extract(rest, r"\(([^)]*)\)", 1)
    source = F.regexp_extract(rest, r"(?:\)|\S\s{2,})\s*([^\s()].*?)\s*$", 1)
    return [F.trim(head).alias("name"), desc.alias("description"), F.trim(unit).alias("units"), source.alias("source")]


def parse_title(title: str) -> tuple[str, str, str, str]:
    """The same for one string."""
    head, sep, rest = title.partition(":")
    if not sep or "(" in head:
        head, rest = "", title
    desc = re.match(r"^\s*([^(]*?)\s*(?:\(|\s{2,}|$)", rest)[1]
    unit = re.search(r"\(([^)]*)\)", rest)
    source = re.search(r"(?:\)|\S\s{2,})\s*([^\s()].*?)\s*$", rest)
    return head.strip(), desc, unit[1].strip() if unit else "", source[1] if source else ""
