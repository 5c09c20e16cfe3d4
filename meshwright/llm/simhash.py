"""SimHash near-duplicates linked through a Gray-order hierarchical index.

Every text gets a 64-bit fingerprint of its word shingles. Two fingerprints at
most ``max_bits`` apart agree on two of their four 16-bit blocks, so each of the
six block pairs is an upper index node: a shared masked bit pattern with no
difference. Below it the fingerprints stand in Gray order, where neighbours
share long patterns; every group of eight factors its common bits out into a
node, and groups of eight nodes again. A search carries the differences found so
far down the tree and drops a whole group once they exceed ``max_bits``.

Only distinct fingerprints enter the index, so exact copies cost nothing, and a
block pair that more than ``bucket_limit`` distinct fingerprints share is split
exactly: two fingerprints at most two bits apart share a value at most one bit
from each, so grouping by those values finds all the links in groups of at most
33 members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HIGHEST, arrow_map, discard, key, pieces, schema, scratch, table, unkey
from .components import components

FANOUT = 8
BLOCK_PAIRS = list(combinations(range(4), 2))
FP = "id:long fp:long"
EDGE = "u:long v:long"


# -- fingerprints ---------------------------------------------------------------------------------------------------
def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text; 0 if it has no word."""
    w = text.lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[k:] for k in range(words)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(s, seed) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """``(id, text)`` to ``(id, fp)``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            texts = piece.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            yield table(FP, piece.column(0), [fingerprint(t, words, seed) for t in texts])

    return docs.select("id", "text").transform(arrow_map, run, schema(FP))


# -- the index ------------------------------------------------------------------------------------------------------
def gray_rank(code: np.ndarray) -> np.ndarray:
    """The position of each 64-bit word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        code = code ^ (code >> np.uint64(s))
    return code


def gray_word(rank: np.ndarray) -> np.ndarray:
    return rank ^ (rank >> np.uint64(1))


class GrayIndex:
    """A forest over words that are sorted by (bucket, Gray rank): one tree for each bucket."""

    def __init__(self, words: np.ndarray, bucket: np.ndarray) -> None:
        self.words = words
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # first child, last child, pattern, residual mask
        ones, zeros, owner = words, ~words, bucket
        masks = []
        while True:
            n = len(owner)
            new = np.r_[True, owner[1:] != owner[:-1]]
            run = np.flatnonzero(new)
            cut = np.flatnonzero((np.arange(n) - run[np.cumsum(new) - 1]) % FANOUT == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, cut), np.bitwise_and.reduceat(zeros, cut)
            masks.append(ones | zeros)
            self.levels.append((cut, np.r_[cut[1:], n], ones, ones | zeros))
            owner = owner[cut]
            if len(cut) == len(run):
                break
        # a child keeps only what its parent does not already say
        for k in range(len(self.levels) - 1):
            lo, hi, pattern, mask = self.levels[k]
            up = np.repeat(np.arange(len(self.levels[k + 1][0])), self.levels[k + 1][1] - self.levels[k + 1][0])
            self.levels[k] = (lo, hi, pattern, mask & ~masks[k + 1][up])
        leaf = np.repeat(np.arange(len(self.levels[0][0])), self.levels[0][1] - self.levels[0][0])
        self.rest = ~masks[0][leaf]
        self.tops = self.levels[-1]
        self.top_of = np.cumsum(np.r_[True, bucket[1:] != bucket[:-1]]) - 1

    def links(self, query: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j) with i in query, i < j, in one bucket and at most ``most`` bits apart."""
        q, node = query, self.top_of[query]
        acc = np.bitwise_count((self.words[q] ^ self.tops[2][node]) & self.tops[3][node]).astype(np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            lo, hi, _, _ = self.levels[k]
            size = hi[node] - lo[node]
            child = np.repeat(lo[node] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum()) if len(size) else lo[:0]
            q, acc = np.repeat(q, size), np.repeat(acc, size)
            if k:
                pattern, rest = self.levels[k - 1][2][child], self.levels[k - 1][3][child]
            else:
                pattern, rest = self.words[child], self.rest[child]
            acc = acc + np.bitwise_count((self.words[q] ^ pattern) & rest)
            keep = acc <= most
            q, acc, node = q[keep], acc[keep], child[keep]
        keep = q < node
        return q[keep], node[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The member of least rank in each member's class, by repeated hooking and jumping."""
    best = np.arange(n)[np.argsort(rank, kind="stable")]
    place = np.empty(n, dtype=np.int64)
    place[best] = np.arange(n)
    root, a, b = np.arange(n), place[a], place[b]
    while True:
        low = np.minimum(root[a], root[b])
        old = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if np.array_equal(root, old):
            return best[root[place]]


def bucket_links(ids: np.ndarray, ranks: np.ndarray, bucket: np.ndarray, most: int, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, smaller id) of the fingerprints of whole buckets, sorted by (bucket, Gray rank)."""
    many = np.r_[True, bucket[1:] != bucket[:-1]]
    alone = many & np.r_[many[1:], True]
    ids, ranks, bucket = ids[~alone], ranks[~alone], bucket[~alone]
    if not len(ids):
        return ids, ids
    index = GrayIndex(gray_word(ranks), bucket)
    found = [index.links(np.arange(at, min(at + chunk, len(ids))), most) for at in range(0, len(ids), chunk)]
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
    root = _roots(len(ids), a, b, ids)
    keep = root != np.arange(len(ids))
    return ids[keep], ids[root[keep]]


def _search(most: int, rows: int = 1 << 15):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def out(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
            combo, rank, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
            head = rank >> np.uint64(32)
            new = np.r_[True, (head[1:] != head[:-1]) | (combo[1:] != combo[:-1])]
            u, v = bucket_links(ids, rank, np.cumsum(new), most)
            if len(u):
                yield table(EDGE, u, v)

        for batch in batches:
            combo, rank, ids = (np.asarray(batch.column(k)) for k in range(3))
            rank = rank.view(np.uint64)
            if not len(ids):
                continue
            held.append((combo, rank, ids))
            if sum(len(x[0]) for x in held) >= rows:
                combo, rank, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                head = rank >> np.uint64(32)
                whole = int(np.flatnonzero((head == head[-1]) & (combo == combo[-1]))[0])  # the last bucket may go on
                if whole:
                    yield from out([(combo[:whole], rank[:whole], ids[:whole])])
                held = [(combo[whole:], rank[whole:], ids[whole:])]
        if held:
            yield from out(held)

    return run


def _permuted(fp: Column, pair: tuple[int, int]) -> Column:
    order = [*pair, *(k for k in range(4) if k not in pair)]
    parts = [F.shiftleft(F.shiftrightunsigned(fp, 48 - 16 * k).bitwiseAND(F.lit(0xFFFF)), 48 - 16 * n) for n, k in enumerate(order)]
    return parts[0].bitwiseOR(parts[1]).bitwiseOR(parts[2]).bitwiseOR(parts[3])


def _gray(word: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        word = word.bitwiseXOR(F.shiftrightunsigned(word, s))
    return word


def fingerprint_links(distinct: DataFrame, max_bits: int = 2, bucket_limit: int = 1 << 16) -> DataFrame:
    """``(node, fp)``, one row for each fingerprint, to links ``(u, v)`` that span every class at ``max_bits``."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the block pairs find fingerprints at most 2 bits apart")
    rows = distinct.select("node", F.explode(F.array(*(F.struct(F.lit(k).alias("combo"), _permuted(F.col("fp"), p).alias("word")) for k, p in enumerate(BLOCK_PAIRS)))).alias("x")).select("x.combo", "x.word", "node")
    rows = rows.select("combo", _gray(F.col("word")).alias("rank"), "node")
    rows = scratch(rows, "gray")
    head = F.shiftrightunsigned("rank", 32)
    counts = rows.groupBy("combo", head.alias("head")).agg(F.count("*").alias("n")).filter("n > 1")
    counts = scratch(counts, "buckets")  # only buckets with two fingerprints can link any
    rows = rows.withColumn("head", head).join(counts, ["combo", "head"])
    usual = rows.filter(F.col("n") <= bucket_limit).select("combo", "rank", "node", "head")
    usual = usual.repartition("combo", "head").sortWithinPartitions("combo", "rank").drop("head")
    usual = usual.transform(arrow_map, _search(max_bits), schema(EDGE))
    low = F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", 1)).bitwiseAND(F.lit(0xFFFFFFFF))
    # at most two bits apart: a value at most one bit from each; at most one: the same bits but one
    near = F.array(low, *(low.bitwiseXOR(F.lit(1 << k)) for k in range(32))) if max_bits == 2 else F.array(*(low.bitwiseAND(F.lit(0xFFFFFFFF ^ 1 << k)).bitwiseOR(F.lit(k << 32)) for k in range(32)))
    hot = rows.filter(F.col("n") > bucket_limit).select("combo", "head", "node", F.explode(near).alias("near"))
    if max_bits:
        least = scratch(hot.groupBy("combo", "head", "near").agg(F.min("node").alias("least"), F.count("*").alias("k")).filter("k > 1"), "hot")
        hot = hot.join(least, ["combo", "head", "near"]).select(F.col("node").alias("u"), F.col("least").alias("v"))
        return usual.union(hot.filter("u <> v"))
    return usual


# -- the operator ---------------------------------------------------------------------------------------------------
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2, seed: int = 42, bucket_limit: int = 1 << 16) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id``.

    Null and empty texts have fingerprint zero and link like any other. A null id
    stays null and counts above every id, so it names a class only if the class
    has no other id. Repeated rows come back once each; an empty table gives an
    empty one; a text of any length counts whole; ids that tie for the least of a
    class are one id. Other columns are ignored, whatever their names.
    """
    fps = scratch(fingerprints(docs.select(key(docs[id_col], HIGHEST).alias("id"), docs[text_col].alias("text")), words, seed), "fp")
    ids = fps.groupBy("fp").agg(F.min("id").alias("id"))
    ids = scratch(ids, "ids")
    rooted = scratch(components(fingerprint_links(ids.select("fp", F.col("fp").alias("node")), max_bits, bucket_limit)), "rooted")
    alone = ids
    ids = scratch(alone.join(rooted.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "roots")
    best = scratch(ids.groupBy("root").agg(F.min("id").alias("component")), "best")
    least = scratch(ids.join(best, "root").select("fp", "component"), "class")
    discard(alone, rooted, ids, best)
    out = fps.join(least, "fp")
    return out.select(unkey(F.col("id"), HIGHEST).alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), unkey(F.col("component"), HIGHEST).alias("component_id"))
