"""Line deduplication with once-seen and twice-seen Bloom filters.

The hashes of all long lines go through a pair of filters for each range of
hashes (``repeats.suspected``). Lines whose hash enough rows hold are then counted
exactly, by their whole key, and the document that keeps each is chosen; other
lines never leave their document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWEST, arrow_map, discard, key, pieces, scratch, unkey
from .repeats import PART_BITS, suspected
from .tokens import SEPARATORS


SALTS = 16


def long_keys(text: bytes, min_chars: int) -> set[bytes]:
    """The keys of at least ``min_chars`` code points in a text."""
    out = set()
    for line in text.split(b"\n"):
        if len(line) >= min_chars:
            k = line.strip(SEPARATORS).lower()
            if len(k) >= min_chars and (k.isascii() or len(k.decode()) >= min_chars):
                out.add(k)
    return out


def _hashes(keys) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(k, 7) for k in keys], dtype=np.uint64)


def _texts(piece: pa.RecordBatch) -> list[bytes]:
    return piece.column(1).cast(pa.binary()).fill_null(b"").to_pylist()


def _all_hashes(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for piece in pieces(batches, "text"):
            found = [_hashes(long_keys(t, min_chars)) for t in _texts(piece)]
            yield np.repeat(np.asarray(piece.column(0)), [len(x) for x in found]), np.concatenate([np.zeros(0, np.uint64), *found])

    return run


def _keys(min_chars: int):
    """The long keys whose hashes are in the row's list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            found = [list(long_keys(t, min_chars)) for t in _texts(piece)]
            listed = np.unique(np.asarray(piece.column(3).flatten()))
            flat = [k for x in found for k in x]
            hit = np.flatnonzero(np.isin(_hashes(flat).view(np.int64), listed))
            rows = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found])[hit])
            if len(hit):
                yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(2).take(rows), pa.array([flat[k] for k in hit], pa.binary()).cast(pa.string())], names=["row", "id", "key"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        drops = piece.column(3).to_pylist()
        texts, n_lines, n_dropped = [], [], []
        for text, drop in zip(_texts(piece), drops, strict=True):
            lines = text.split(b"\n")
            if drop:
                drop = {d.encode() for d in drop}
                kept = [x for x in lines if x.strip(SEPARATORS).lower() not in drop]
            else:
                kept = lines
            texts.append(b"\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(texts, pa.binary()).cast(pa.string()), piece.column(2), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["id", "text", "row", "n_lines", "n_dropped"])


def _salted(many: DataFrame, few: DataFrame, on: str, spread: Column) -> DataFrame:
    """``many`` with what ``few`` says of ``on``; the rows of one value, which may be a third of all, go to SALTS tasks."""
    salt = F.pmod(spread, F.lit(SALTS)).cast("int").alias("salt")
    each = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return many.select("*", salt).join(each, [on, "salt"]).drop("salt")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, carry: list[str] | None = None, part_bits: int = PART_BITS) -> DataFrame:
    """Drop repeated long lines: ``id, text, n_lines, n_dropped, row``, the last a struct of the columns in ``carry``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    A key of at least ``min_chars`` code points that ``min_docs`` documents hold
    stays only in the largest id among them. Null and empty texts are one empty
    line; an empty table gives an empty one; a text of any length is worked on
    whole. Rows of one id are one document: they count once, and all keep the lines
    that this id keeps. Null ids together are one document, below every id. Ties
    can't occur, as the largest id is one document. Other columns take no part,
    whatever their names.
    """
    carried = F.struct(*(docs[c].alias(c) for c in carry)) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(key(docs[id_col], LOWEST).alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), carried.alias("row"))
    rows = rows.withColumn("own", F.xxhash64("id", "text"))  # rows that share it only share a list of suspects
    chars = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = suspected(rows.select("own", "text"), _all_hashes(min_chars), chars // max(min_chars, 1), part_bits)
    # a key that enough documents hold has a hash that enough rows hold
    likely = scratch(found.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("hash"), "likely")
    listed = _salted(found, likely, "hash", F.col("key")).groupBy("key").agg(F.collect_list("hash").alias("hashes"))
    lists = scratch(listed, "lists")
    discard(found, likely)
    # lists and drops grow with the corpus, so they are never broadcast
    held = scratch(rows.join(lists.hint("merge"), F.col("own") == F.col("key"), "left").select("id", "text", "row", "own", "hashes"), "lines")
    discard(lists)
    some = held.filter("hashes is not null")
    once = scratch(some.select("own", "text", "id", "hashes").transform(arrow_map, _keys(min_chars), "row long, id long, key string"), "keys")
    repeated = once.groupBy("key").agg(F.count_distinct("id").alias("n"), F.max("id").alias("keeper")).filter(F.col("n") >= min_docs).select("key", "keeper")
    repeated = scratch(repeated, "repeated")
    drops = _salted(once, repeated, "key", F.col("row")).filter("id <> keeper").select("row", "id", "key").distinct()
    drops = scratch(drops.groupBy(F.col("row").alias("own"), "id").agg(F.collect_list("key").alias("drops")), "drops")
    discard(once, repeated)
    plain = held.filter("hashes is null").withColumn("drops", F.lit(None).cast("array<string>"))
    out = plain.unionByName(some.join(drops.hint("merge"), ["own", "id"], "left")).select("id", "text", "row", "drops")
    out = out.transform(arrow_map, _apply, T.StructType(out.schema.fields[:3]).add("n_lines", "long").add("n_dropped", "long"))
    return out.withColumn("id", unkey(F.col("id"), LOWEST))


ORACLE = """
WITH lines AS (
  SELECT doc_id, pos, line, lower_az AS key, length(lower_az) AS n FROM (
    SELECT doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_az
    FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)))
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE n >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.*, coalesce(r.keeper <> l.doc_id, false) AS gone FROM lines l LEFT JOIN repeated r USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
