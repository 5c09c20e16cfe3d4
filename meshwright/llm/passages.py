"""Substring deduplication with automata of recurring passages.

1. Every window of ``window`` words has an anchor, the least hash of its 5-word
   parts. Equal windows have equal anchors, so windows whose anchor no other text
   has are unique. Anchors go through once-seen and twice-seen filters by range,
   then they are counted exactly. Neighbouring windows with one recurring anchor
   make a stretch of some twenty words.
2. Passages are confirmed: equal stretches are put together, their windows counted
   by their words, and each window that two ids have is kept once, with its
   least id.
3. The table of passages is dealt to shards by anchor, at most about
   ``shard_chars`` characters each, and every shard is compiled to an Aho-Corasick
   automaton over word codes. The stretches of all documents stream through the
   automata of their anchor's shard, which locate every occurrence of a passage.
   A shard that many stretches meet is compiled in several tasks.
4. Every document loses the words that located passages of a smaller id cover.

Only the first of exactly equal texts enters these steps: the others' windows
all stand in it. Documents without a recurring anchor shuffle once, to find
equal texts and their anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HIGHEST, arrow_map, discard, key, pieces, routed, routed_runs, schema, scratch, table, unkey
from .repeats import PART_BITS, suspected
from .tokens import WordBatch, mix64, rolling

WINDOW, ANCHOR = 13, 5
#: Characters of passages in an automaton, about 30 bytes of memory each; stretches that one task streams through it.
SHARD_CHARS = 1 << 19
SHARD_ROWS = 1 << 19
STRETCH = "row long, id long, place int, anchor long, words string"
HIT = "row:long lo:long hi:long"


def anchors(batch: WordBatch, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The start word of every window and the hash of its anchor."""
    at = batch.windows(window)
    grams = rolling(batch.hash, min(ANCHOR, window))
    if not len(at):
        return at, grams[:0]
    least = sliding_window_view(grams, window - min(ANCHOR, window) + 1).min(axis=1)
    return at, mix64(least[at])


def _anchor_hashes(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for piece in pieces(batches, "text"):
            batch = WordBatch(piece.column(1))
            at, h = anchors(batch, window)
            if not len(at):
                continue
            row = batch.row[at]
            new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
            order = np.lexsort((h[new], row[new]))
            row, h = row[new][order], h[new][order]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
            yield np.asarray(piece.column(0))[row[new]], h[new]

    return run


def _stretches(window: int):
    """Runs of windows with one recurring anchor: where they start in their row, and their words joined by single spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            batch = WordBatch(piece.column(2))
            at, h = anchors(batch, window)
            # an anchor that recurs is in the list of every row that has it
            good = np.isin(h.view(np.int64), np.unique(np.asarray(piece.column(3).flatten())))
            at, h = at[good], h[good]
            if not len(at):
                continue
            row = batch.row[at]
            new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(at)] - 1
            lo, hi = batch.start[at[first]], batch.end[at[last] + window - 1]
            raw = batch.buf.tobytes()
            words = [b" ".join(raw[a:b].split()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            rows = pa.array(row[first])
            place = (at[first] - batch.first[row[first]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), piece.column(1).take(rows), pa.array(place), pa.array(h[first].view(np.int64)), pa.array(words, pa.binary()).cast(pa.string())], names=["row", "id", "place", "anchor", "words"])

    return run


def _windows(window: int):
    """Every window of a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "words"):
            batch = WordBatch(piece.column(1))
            at = batch.windows(window)
            raw = batch.buf.tobytes()
            words = [raw[a:b] for a, b in zip(batch.start[at].tolist(), batch.end[at + window - 1].tolist(), strict=True)]
            rows = pa.array(batch.row[at])
            yield pa.RecordBatch.from_arrays([piece.column(0).take(rows), pa.array(words, pa.binary()).cast(pa.string()), piece.column(2).take(rows), piece.column(3).take(rows)], names=["anchor", "words", "low", "high"])

    return run


class Phrases:
    """An Aho-Corasick automaton of passages of ``window`` words each.

    A word is two characters: its number in the shard's vocabulary, in two digits
    of disjoint alphabets, so matches can't begin inside a word. A mark that is in
    no passage stands for other words and between rows.
    """

    MARK, LEAST = 0x100, 0x200

    def __init__(self, passages: pa.Array, least: np.ndarray, window: int = WINDOW) -> None:
        self.window, self.least = window, least
        batch = WordBatch(passages)
        self.vocabulary, number = np.unique(batch.hash, return_inverse=True)
        self.side = int(np.ceil(np.sqrt(max(1, len(self.vocabulary)))))
        text = self._coded(number, np.arange(len(number)), len(number))
        self.automaton = ahocorasick.Automaton()
        size = 2 * window
        for k in range(len(passages)):
            self.automaton.add_word(text[size * k : size * (k + 1)], k)
        self.automaton.make_automaton()

    def _coded(self, number: np.ndarray, place: np.ndarray, n: int) -> str:
        """Words as text: word k, if its number isn't negative, at ``place[k]`` of ``n``."""
        codes = np.full((n, 2), self.MARK, np.uint32)
        known = number >= 0
        codes[place[known], 0] = self.LEAST + number[known] // self.side
        codes[place[known], 1] = self.LEAST + self.side + number[known] % self.side
        return codes.tobytes().decode("utf-32-le")

    def locate(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word within the row, passage) of all occurrences, in order."""
        batch = WordBatch(texts)
        none = np.zeros(0, np.int64)
        if not len(batch) or not len(self.vocabulary):
            return none, none, none
        at = np.minimum(np.searchsorted(self.vocabulary, batch.hash), len(self.vocabulary) - 1)
        number = np.where(self.vocabulary[at] == batch.hash, at, -1)
        row = batch.row
        place = np.arange(len(batch)) + row  # a mark before each row but the first
        hits = list(self.automaton.iter(self._coded(number, place, int(place[-1]) + 1)))
        if not hits:
            return none, none, none
        hits = np.array(hits, dtype=np.int64)
        word = np.searchsorted(place, hits[:, 0] // 2) - self.window + 1
        return row[word], word - batch.first[row[word]], hits[:, 1]


def _locate(window: int, phrase_type: type):
    """Runs of the windows (row, first, end) that are passages of a smaller id, from routed passages and stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        phrases = None
        for new, kind, part in routed_runs(batches):
            if new:
                held, phrases = [], None
            if kind == 0:
                held.append(part)
                continue
            if phrases is None:
                if not held:  # a part that no passage was dealt to
                    continue
                shard = pa.Table.from_batches(held).combine_chunks()
                phrases = phrase_type(shard.column(0).combine_chunks(), np.asarray(shard.column(1)), window)
                held = []
            for piece in pieces(iter([part]), "words"):
                row, word, passage = phrases.locate(piece.column(5))
                gone = phrases.least[passage] < np.asarray(piece.column(3))[row]
                row, word = row[gone], word[gone]
                if not len(row):
                    continue
                first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (word[1:] != word[:-1] + 1)])
                last = np.r_[first[1:], len(row)] - 1
                at = np.asarray(piece.column(4)).astype(np.int64)[row]
                yield table(HIT, np.asarray(piece.column(2))[row[first]], at[first] + word[first], at[last] + word[last] + 1)

    return run


def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            kept, n_words, n_removed = [], [], []
            for text, copy, lows, highs in zip(piece.column(1).cast(pa.binary()).to_pylist(), *(piece.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                if copy and len(words) >= window:
                    gone[0] = 1
                for lo, hi in zip(lows or (), highs or (), strict=True):
                    gone[lo] += 1
                    gone[hi + window - 1] -= 1
                out = np.cumsum(gone[:-1]) > 0
                n = int(out.sum())
                kept.append(b" ".join(words if not n else [words[k] for k in np.flatnonzero(~out)]))
                n_words.append(len(words))
                n_removed.append(n)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=["id", "text", "n_words", "n_removed"])

    return run


def remove_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_chars: int = SHARD_CHARS, part_bits: int = PART_BITS, phrase_type: type = Phrases) -> DataFrame:
    """``id, text, n_words, n_removed``: the texts' words without those in passages that a smaller id has.

    A word goes if any ``window`` consecutive words around it, in the input, also
    start in a document of smaller id. Kept words are joined by one space. Null and
    empty texts have no words; an empty table gives an empty one; a text of any
    length is worked on whole. Rows of one id are one document, whose parts take
    nothing from each other, so there are no ties; null ids together are one
    document above every id. Repeated rows come back once each; other columns are
    ignored, whatever their names. ``phrase_type`` compiles a shard's automaton.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(key(docs[id_col], HIGHEST).alias("id"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"))
    texts = scratch(rows.select("id", "sha"), "texts")
    firsts = scratch(texts.groupBy("sha").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("sha", "first"), "firsts")
    copies = scratch(texts.join(firsts, "sha").filter("id > first").select("id", "sha").distinct(), "copies")
    # the copies grow with the corpus, so they are never broadcast
    work = rows.join(copies.withColumn("copy", F.lit(True)).hint("merge"), ["id", "sha"], "left").select(F.monotonically_increasing_id().alias("row"), "id", "text", F.coalesce("copy", F.lit(False)).alias("copy"))
    work = scratch(work, "work")
    discard(texts, firsts, copies)
    chars = work.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # about every fifth word of some six letters is an anchor of its own
    found = suspected(work.filter("not copy").select("row", "text"), _anchor_hashes(window), chars // 10, part_bits)
    common = scratch(found.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"), "common")
    lists = scratch(found.join(common, "hash").groupBy("key").agg(F.collect_list("hash").alias("anchors")), "lists")
    discard(found, common)
    held = scratch(work.join(lists, F.col("row") == F.col("key"), "left").select("row", "id", "text", "copy", "anchors"), "held")
    discard(work, lists)
    some = held.filter("anchors is not null")
    stretches = scratch(some.select("row", "id", "text", "anchors").transform(arrow_map, _stretches(window), STRETCH), "stretches")
    distinct = scratch(stretches.groupBy("anchor", "words").agg(F.min("id").alias("low"), F.max("id").alias("high")), "distinct")
    passages = distinct.transform(arrow_map, _windows(window), "anchor long, words string, low long, high long")
    passages = passages.groupBy("anchor", "words").agg(F.min("low").alias("least"), F.max("high").alias("most")).filter("least < most")
    passages = scratch(passages.select("anchor", F.col("words").alias("passage"), "least"), "passages")
    discard(distinct)
    size = passages.agg(F.sum(F.length("passage"))).first()[0] or 0
    # shards are half full on average, so few must be dealt to several automata, which all their stretches would meet
    shard = F.pmod("anchor", F.lit(max(1, -(-2 * size // shard_chars)))).alias("group")
    met, plan = routed(passages.select(shard, "passage", "least"), stretches.select(shard, "row", "id", "place", "words"), F.length("passage"), shard_chars, F.lit(1), SHARD_ROWS)
    hits = scratch(met.transform(arrow_map, _locate(window, phrase_type), schema(HIT)), "hits")
    discard(stretches, passages, plan)
    places = scratch(hits.groupBy("row").agg(F.collect_list("lo").alias("lows"), F.collect_list("hi").alias("highs")), "places")
    discard(hits)
    none = F.lit(None).cast("array<long>")
    out = some.join(places, "row", "left").select("id", "text", "copy", "lows", "highs").union(held.filter("anchors is null").select("id", "text", "copy", none, none))
    out = out.transform(arrow_map, _remove(window), "id long, text string, n_words long, n_removed long")
    return out.withColumn("id", unkey(F.col("id"), HIGHEST))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM d
), s AS (
  SELECT doc_id, unnest(range(1, len(ws) - 11)) AS p, ws FROM d WHERE len(ws) >= 13
), r AS (
  SELECT doc_id, p, min(doc_id) OVER (PARTITION BY array_to_string(ws[p:p + 12], ' ')) < doc_id AS hit FROM s
), m AS (
  SELECT w.doc_id, w.p, w.w, coalesce(max(CAST(hit AS INT)) OVER (PARTITION BY w.doc_id ORDER BY w.p ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id AND w.p = r.p
), g AS (
  SELECT doc_id, count(*) AS n_words, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, string_agg(w, ' ' ORDER BY p) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
