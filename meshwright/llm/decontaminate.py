"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over consecutive words; the words under a 0 do not enter
its hash. The two masks are lossless for their task: whichever 2 of 13 aligned
words are replaced, one of them still lies on equal words somewhere inside (a
test tries all of the cases). A hit of equal hashes is only a candidate; the item
is then laid against the document at that offset, and its windows are counted
word by word.

The benchmark is the stated query set. It is worked through in blocks of at most
about ``block_words`` words, each broadcast in turn, so its size has no bound
and the documents never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, pieces, schema, scratch, table
from .tokens import NOT_ALNUM, WordBatch, mix64

MASKS = ("11101011", "11001111")
WINDOW, MISSES = 13, 2
#: Shorter items are common phrases, and no reason to remove a document.
LEAST_WORDS = 5
HITS = "doc_id:long item_id:long n_words:long n_covered:long"


def seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every position where the mask fits."""
    n = len(hashes) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), dtype=np.uint64)
    for at, bit in enumerate(mask):
        if bit == "1" and n > 0:
            out = (out ^ hashes[at : at + n]) * np.uint64(0x9FB21C651E98DF25)
            out ^= out >> np.uint64(29)
    return mix64(out)


class SeedIndex:
    """Seeds of a block of items, to look the seeds of documents up in."""

    def __init__(self, ids: np.ndarray, words: list[np.ndarray]) -> None:
        self.ids, self.words = ids, words
        size = np.array([len(w) for w in words], dtype=np.int64)
        self.masks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for mask in [*MASKS, *("1" * m for m in sorted(set(size[size < WINDOW].tolist()) - {0}))]:
            own = np.flatnonzero(size >= WINDOW) if mask in MASKS else np.flatnonzero(size == len(mask))
            if not len(own):
                continue
            found = [seeds(words[k], mask) for k in own]
            h = np.concatenate(found)
            item = np.repeat(own, [len(x) for x in found])
            pos = np.concatenate([np.arange(len(x)) for x in found])
            order = np.argsort(h, kind="stable")
            h, item, pos = h[order], item[order], pos[order]
            bits = max(16, int(len(h) - 1).bit_length() + 4)
            maybe = np.zeros(1 << bits, dtype=bool)
            maybe[h >> np.uint64(64 - bits)] = True
            self.masks[mask] = (h, item, pos, maybe)

    def covered(self, item: int, doc: np.ndarray, offset: int) -> np.ndarray:
        """Which words of the item lie in a matching window when its word 0 stands at ``doc[offset]``."""
        own = self.words[item]
        size = min(len(own), WINDOW)
        need = size - MISSES if size == WINDOW else size
        out = np.zeros(len(own), dtype=bool)
        lo, hi = max(0, -offset), min(len(own), len(doc) - offset)
        if hi - lo < size:
            return out
        equal = np.zeros(len(own), dtype=np.int64)
        equal[lo:hi] = own[lo:hi] == doc[offset + lo : offset + hi]
        sums = np.r_[0, np.cumsum(equal)]
        start = np.arange(lo, hi - size + 1)
        for s in start[sums[start + size] - sums[start] >= need]:
            out[s : s + size] = True
        return out

    def hits(self, batch: WordBatch) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, words of the item, covered words of the item) of rows that hold a matching window."""
        row = batch.row
        found = []
        for mask, (h, item, pos, maybe) in self.masks.items():
            s = seeds(batch.hash, mask)
            at = np.flatnonzero(maybe[s >> np.uint64(64 - (len(maybe) - 1).bit_length())])
            at = at[row[at] == row[at + len(mask) - 1]]
            lo, hi = np.searchsorted(h, s[at], "left"), np.searchsorted(h, s[at], "right")
            n = hi - lo
            k = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else lo
            at = np.repeat(at, n)
            found.append(np.stack([row[at], item[k], at - pos[k] - batch.first[row[at]]], axis=1))
        if not found:
            return
        cases = np.unique(np.concatenate(found), axis=0)
        cover: dict[tuple[int, int], np.ndarray] = {}
        for r, i, offset in cases.tolist():
            c = self.covered(i, batch.hash[batch.first[r] : batch.first[r + 1]], offset)
            cover[r, i] = cover[r, i] | c if (r, i) in cover else c
        for (r, i), c in sorted(cover.items()):
            if c.any():
                yield r, i, len(c), int(c.sum())


def item_words(texts: pa.Array) -> list[np.ndarray]:
    batch = WordBatch(texts, lower=True, apart=NOT_ALNUM)
    return [batch.hash[a:b] for a, b in zip(batch.first[:-1], batch.first[1:], strict=True)]


class Items:
    """A block of the benchmark; each Python worker builds its index once."""

    def __init__(self, names: list, words: list[np.ndarray], least_words: int) -> None:
        own = [k for k, w in enumerate(words) if len(w) >= least_words]
        self.names, self.words = [names[k] for k in own], [words[k] for k in own]

    @cached_property
    def index(self) -> SeedIndex:
        return SeedIndex(np.arange(len(self.names)), self.words)


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, block_words: int, least_words: int) -> Iterator:
    """Broadcasts of Items, a block of the benchmark at a time."""
    items = benchmark.select(benchmark[item_col].cast("long").alias("item"), F.coalesce(benchmark[item_text_col], F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))  # a word takes two bytes at least
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).orderBy("item", "text").toArrow().combine_chunks()
        yield docs.sparkSession.sparkContext.broadcast(Items(own.column("item").to_pylist(), item_words(own.column("text").cast(pa.string())), least_words))


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1 << 20, least_words: int = 1) -> DataFrame:
    """The documents that hold part of a benchmark item: ``doc_id, item_id, n_words, n_covered``.

    Words are runs of ASCII letters and digits, in lower case, and of characters
    beyond ASCII. A document holds part of an item if, at some offset, 11 of 13
    consecutive words of both are equal; an item of fewer than 13 words must stand
    there whole, and items below ``least_words`` count for nothing. ``n_covered`` counts the item's words in such windows. Null and
    empty texts hold nothing, on either side; null ids come back null; repeated
    rows come back once each, repeated items once. Other columns are ignored.
    """
    thin = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    out = None
    for shared in _blocks(docs, benchmark, item_col, item_text_col, block_words, least_words):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, index = shared.value.names, shared.value.index
            for piece in pieces(batches, "text"):
                rows = list(index.hits(WordBatch(piece.column(1), lower=True, apart=NOT_ALNUM)))
                if rows:
                    r, i, n, c = zip(*rows, strict=True)
                    yield table(HITS, piece.column(0).take(pa.array(r, pa.int64())), [names[x] for x in i], n, c)

        part = thin.transform(arrow_map, run, schema(HITS))
        out = part if out is None else out.union(part)
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = 1 << 20, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``overlaps`` finds nothing in; no shuffle, one pass a block.

    Items of fewer than ``least_words`` words remove nothing. What a block leaves is
    written before the next one begins. Null, empty and very
    long texts, repeated rows, empty tables and other columns are as in ``overlaps``.
    """
    rows = docs.select(docs[text_col].cast("string").alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    for k, shared in enumerate(_blocks(docs, benchmark, item_col, item_text_col, block_words, least_words)):
        rows = scratch(rows, "clean") if k else rows

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value.index
            for piece in pieces(batches, "text"):
                clean = np.ones(len(piece), dtype=bool)
                clean[[r for r, *_ in index.hits(WordBatch(piece.column(0), lower=True, apart=NOT_ALNUM))]] = False
                yield piece.filter(pa.array(clean))

        rows = rows.transform(arrow_map, run, rows.schema)
    return rows.select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT doc_id, ws, len(ws) AS n FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS ws FROM documents))
), b AS (
  SELECT item_id, m, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM (SELECT item_id, ws, len(ws) AS m FROM (
    SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-/:-`{-\x7f]+') AS ws FROM benchmark))
), e AS (
  SELECT doc_id, n, item_id, m, d.p - b.p AS diag, b.p AS j, least(m, 13) AS size, CASE WHEN m < 13 THEN m ELSE 11 END AS need FROM d JOIN b USING (w)
), busy AS (
  SELECT doc_id, item_id, diag, any_value(n) AS n, any_value(m) AS m, any_value(size) AS size, any_value(need) AS need, list(j) AS js
  FROM e GROUP BY doc_id, item_id, diag HAVING count(*) >= any_value(need)
), win AS (
  SELECT *, unnest(range(1, m - size + 2)) AS s FROM busy
), good AS (
  SELECT doc_id, item_id, m, s, size FROM win
  WHERE diag + s >= 1 AND diag + s + size - 1 <= n AND len(list_filter(js, lambda j: j >= s AND j < s + size)) >= need
)
SELECT doc_id, item_id, any_value(m) AS n_words, count(DISTINCT x) AS n_covered
FROM (SELECT doc_id, item_id, m, unnest(range(s, s + size)) AS x FROM good) GROUP BY doc_id, item_id
"""
