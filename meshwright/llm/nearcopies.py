"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least 4/5.

Two such texts share at least 4/5 of the shingles of each. Whatever the order of
shingles, the first fifth and one more of their sets, the prefix, always shares
a shingle with that of a partner (prefix filtering). The order puts those last
that a sample of the texts holds twice, so frequent ones are seldom in a prefix;
which texts are in the sample changes the work, not the result. Only prefixes
and bitmaps are stored; filters by range leave those of the prefixes' shingles
that two texts have. Candidates are members of one block, that is, with one
prefix shingle. A passage makes many blocks of the same members, and one of them
stands for all.

Only classes are asked for, so each member is first held against one drawn
member of its block, three times over, which links dense groups at a cost in
proportion to them. In the blocks that still hold several classes, of whatever
size, all pairs of different classes are gone through. A pair needs its sets only
if its sizes and its parity bitmaps allow the similarity: bit k of a bitmap says
whether an odd number of shingles fall on k, so two of them differ in no more
bits than their sets differ in shingles. A bitmap has a bit for each shingle at
least, else those of long texts would allow everything; one half laid upon the
other gives that of half the width. Whole sets are computed for the texts of the
pairs that are left, and go once these are verified. Texts that
``op1_simhash`` links, by fingerprints of 3-word shingles at most two bits
apart, are near copies as well.

Shingles and sets stand as 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_map, discard, pieces, scratch
from .components import components
from .repeats import MAX_BITS, RepeatFilter, filter_bits, repeat_filter, suspected
from .tokens import WordBatch, mix64, rolling

WORDS = 5
LEAST, OF = 4, 5  # the similarity, as a fraction: the prefix below is for 4/5
DRAWS = 3
ORDERED = MAX_BITS // 12  # shingles of the sample that the order is taken from
LONGS = 16  # of the narrowest parity bitmap
SHINGLED = "own long, digest string, sig long, fp long, n int, prefix array<long>, bits array<long>, wide array<long>"
SETS = "sig long, n int, shingles array<long>"


def shingle_sets(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted by text and hash, and where each text's begin and end; a shorter text is one shingle."""
    w = WordBatch(texts, lower=True)
    at = w.windows(words)
    value, row = [rolling(w.hash, words)[at]], [w.row[at]]
    for size in range(1, words):
        short = np.flatnonzero(w.counts == size)
        if len(short):
            value.append(mix64(rolling(w.hash, size)[w.first[short]] + np.uint64(size)))
            row.append(short)
    value, row = np.concatenate(value), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[new], row[new]
    return value, np.searchsorted(row, np.arange(len(texts) + 1))


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for piece in pieces(batches, "text"):
        yield shingle_sets(piece.column(0))[0]


def _signatures(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix64(value ^ np.uint64(0x2545F4914F6CDD1D)), out=sums[1:])
    return mix64(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def parities(value: np.ndarray, first: np.ndarray, longs: int = LONGS) -> np.ndarray:
    """A row of ``longs`` for each set: whether an odd number of its shingles fall on each bit."""
    wide, out = 64 * longs, [np.zeros((0, longs), np.int64)]
    slot = (mix64(value ^ np.uint64(0x9FB21C651E98DF25)) % np.uint64(wide)).astype(np.int64)
    step = max(1, 256 * LONGS // longs)
    for at in range(0, len(first) - 1, step):
        own = first[at : at + step + 1]
        row = np.repeat(np.arange(len(own) - 1), np.diff(own))
        odd = np.bincount(row * wide + slot[own[0] : own[-1]], minlength=wide * (len(own) - 1)) & 1
        out.append(np.packbits(odd.astype(np.uint8).reshape(-1, wide), axis=1).view(np.int64))
    return np.concatenate(out)


def wide_parities(value: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """For each set of more shingles than the narrowest bitmap has bits one of at least as many, a power of two; for others none."""
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        longs = 1 << (-(-(b - a) // 64) - 1).bit_length() if b - a > 64 * LONGS else 0
        out.append(parities(value[a:b], np.array([0, b - a]), longs)[0] if longs else np.zeros(0, np.int64))
    return out


def _shingle(shared, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = RepeatFilter(shared.value)
        for piece in pieces(batches, "text"):
            value, first = shingle_sets(piece.column(2))
            n, hit = np.diff(first), seen.test(value)
            fp = [simhash.fingerprint(t) for t in piece.column(2).cast(pa.binary()).to_pylist()]
            prefixes = [None] * len(n)
            for k in np.flatnonzero(n):
                own, often = value[first[k] : first[k + 1]], hit[first[k] : first[k + 1]]
                length = n[k] // OF + 1
                rare, often = own[~often][:length], own[often][: max(0, length - np.count_nonzero(~often))]
                prefixes[k] = (often if whole else np.concatenate([rare, often])).view(np.int64)  # no other text has what the whole holds once
            bits = pa.ListArray.from_arrays(pa.array(np.arange(len(first), dtype=np.int32) * LONGS), pa.array(parities(value, first).reshape(-1)))
            columns = [piece.column(0), piece.column(1), pa.array(_signatures(value, first)), pa.array(fp, pa.int64()), pa.array(n.astype(np.int32))]
            columns += [pa.array(prefixes, pa.list_(pa.int64())), bits, pa.array(wide_parities(value, first), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["own", "digest", "sig", "fp", "n", "prefix", "bits", "wide"])

    return run


def _sets(shared):
    """The sets of the texts whose hashes the filter knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = RepeatFilter(shared.value)
        some = (b.filter(pa.array(asked.test(np.asarray(b.column(0)).view(np.uint64)))) for b in batches)
        for piece in pieces(some, "text"):
            value, first = shingle_sets(piece.column(1))
            shingles = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_signatures(value, first)), pa.array(np.diff(first).astype(np.int32)), shingles], names=["sig", "n", "shingles"])

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        sizes = np.asarray(b.column(1).value_lengths())
        yield np.repeat(np.asarray(b.column(0)), sizes), np.asarray(b.column(1).flatten()).view(np.uint64)


def _twice(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for b in batches:
        yield np.repeat(np.asarray(b.column(0)).view(np.uint64), 2)


def _near(a: str, b: str):
    """The bitmaps ``a0, a1, ..`` and ``b0, b1, ..`` differ no more than similar sets of sizes ``na`` and ``nb`` do."""
    apart = sum((F.bit_count(F.col(f"{a}{k}").bitwiseXOR(F.col(f"{b}{k}"))) for k in range(LONGS)), F.lit(0))
    return (OF + LEAST) * apart <= (OF - LEAST) * (F.col(f"n{a}") + F.col(f"n{b}"))


def _maps(maps: DataFrame, c: str) -> list:
    return [maps["n"].alias(f"n{c}"), *(F.get("bits", F.lit(k)).alias(f"{c}{k}") for k in range(LONGS))]


def _near_wide():
    """``_near`` by the widest bitmaps ``wu`` and ``wv`` that sets of sizes ``nu`` and ``nv`` have; similar sizes have widths at most one step apart."""
    xor = lambda a, b: a.bitwiseXOR(b)
    half = lambda x, n: F.zip_with(F.slice(x, 1, n), F.slice(x, n + 1, n), xor)
    a, b = (F.when(F.size(x) > F.size(y), half(x, F.size(y))).otherwise(F.col(x)) for x, y in (("wu", "wv"), ("wv", "wu")))
    apart = F.aggregate(F.zip_with(a, b, xor), F.lit(0), lambda total, x: total + F.bit_count(x))
    return (OF + LEAST) * apart <= (OF - LEAST) * (F.col("nu") + F.col("nv"))


def _similar(pairs: DataFrame, maps: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs ``(u, v)`` of similar sizes whose sets are similar enough; only the sets of those that the bitmaps allow are computed."""
    widest = F.when(F.size("wide") > 0, F.col("wide")).otherwise(F.col("bits"))
    for c in "uv":
        pairs = pairs.join(maps.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), widest.alias(f"w{c}")).hint("merge"), c)
    near = scratch(pairs.filter(_near_wide()).select("u", "v"), "near")
    ends = near.select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    asked = scratch(maps.select("sig", "hash").join(ends, "sig").select("hash"), "asked")
    expected = asked.count()
    if not expected:
        discard(asked)
        return near
    known = near.sparkSession.sparkContext.broadcast(repeat_filter(asked, _twice, filter_bits(expected)))
    # a row may stand twice, and the filter knows a few texts that nobody asked for
    sets = scratch(texts.transform(arrow_map, _sets(known), SETS).groupBy("sig").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets")
    pairs = near
    for c in "uv":
        pairs = pairs.join(sets.select(F.col("sig").alias(c), F.col("n").alias(f"n{c}"), F.col("shingles").alias(f"s{c}")).hint("merge"), c)
    both = F.size(F.array_intersect("su", "sv"))
    out = scratch(pairs.filter((OF + LEAST) * both >= LEAST * (F.col("nu") + F.col("nv"))).select("u", "v"), "links")
    discard(near, asked, sets)
    return out


def _fit(a: str, b: str):
    """Sets of these sizes can be similar enough."""
    return OF * F.least(a, b) >= LEAST * F.greatest(a, b)


def _fingerprint_links(rows: DataFrame) -> DataFrame:
    """Links of the sets whose texts ``op1_simhash`` links."""
    held = scratch(rows.select("sig", "fp").distinct(), "held")
    nodes = scratch(held.groupBy("fp").agg(F.min("sig").alias("node")), "nodes")
    same = held.join(nodes, "fp").filter("sig <> node").select(F.col("sig").alias("u"), F.col("node").alias("v"))
    out = scratch(simhash.fingerprint_links(nodes.select("node", "fp")).union(same), "links")
    discard(held, nodes)
    return out


def _rooted(blocks: DataFrame, links: list[DataFrame]) -> DataFrame:
    """The members of blocks that more than one class shares, with their roots."""
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    roots = components(every).withColumnRenamed("node", "sig")
    out = scratch(blocks.join(roots, "sig", "left").withColumn("root", F.coalesce("root", "sig")), "rooted")
    mixed = scratch(out.groupBy("block").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b").select("block"), "mixed")
    left = scratch(out.join(mixed, "block", "left_semi"), "left")
    discard(out, mixed)
    return left


def _candidates(keyed: DataFrame, ordered: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``rows (own, digest, sig, fp, ..)`` of all texts; of those with candidates ``maps (sig, hash, n, bits, wide)``, hash being that of a row, and ``blocks (sig, n, block)``. All are scratch tables."""
    spark = keyed.sparkSession
    chars = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-(chars // 6) // ordered))
    sample = keyed.filter(F.pmod(F.xxhash64("digest"), F.lit(parts)) == 0).select("digest", "text").dropDuplicates(["digest"])
    shared = spark.sparkContext.broadcast(repeat_filter(sample.select("text"), _distinct, filter_bits(chars // 6 // parts)))
    every = scratch(keyed.transform(arrow_map, _shingle(shared, parts == 1), SHINGLED), "shingled")
    prefixes = scratch(every.filter(F.size("prefix") > 0).groupBy("sig").agg(F.first("prefix").alias("prefix")), "prefixes")
    rows = scratch(every.drop("prefix"), "rows")
    discard(every)
    expected = prefixes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    found = suspected(prefixes.select("sig", "prefix"), _prefixes, expected)
    discard(prefixes)
    members = [F.count("*").alias("members"), *(F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"mark{k}") for k in (1, 2))]
    shares = found.groupBy("hash").agg(*members).filter("members > 1").groupBy("members", "mark1", "mark2").agg(F.min("hash").alias("hash")).select("hash")
    some = scratch(found.join(shares, "hash").select(F.col("key").alias("sig"), F.col("hash").alias("block")), "shares")
    discard(found)
    own = rows.join(some.select("sig").distinct().hint("merge"), "sig", "left_semi").groupBy("sig")
    own = own.agg(F.min(F.struct("own", "digest")).alias("one"), *(F.first(c).alias(c) for c in ("n", "bits", "wide")))
    maps = scratch(own.select("sig", F.xxhash64("one.own", "one.digest").alias("hash"), "n", "bits", "wide"), "maps")
    blocks = scratch(some.join(maps.select("sig", "n").hint("merge"), "sig").select("sig", "n", "block"), "blocks")
    discard(some)
    return rows, maps, blocks


def near_copies(keyed: DataFrame, ordered: int = ORDERED) -> DataFrame:
    """``(own, digest, text)`` to ``(own, digest, root)``, one row each: texts have one root if a chain of near copies joins them.

    Words are separated by ASCII white space, ASCII letters count as lower case. A
    text of less than five words has one shingle, all of it; null and empty texts
    have none and are copies of each other. ``ordered`` shingles at most are sampled
    for the order, which the result does not depend on.
    """
    keyed = keyed.select("own", "digest", F.coalesce("text", F.lit("")).alias("text"))
    rows, maps, blocks = _candidates(keyed, ordered)
    texts = keyed.select(F.xxhash64("own", "digest").alias("hash"), "text")
    links = [_fingerprint_links(rows)]
    left = blocks.withColumn("root", F.col("sig"))
    for draw in range(DRAWS):
        drawn = F.min(F.struct(F.xxhash64("sig", F.lit(draw)).alias("x"), F.col("sig").alias("v"), F.col("n").alias("m"), F.col("root").alias("other"))).alias("h")
        hubs = scratch(left.groupBy("block").agg(drawn, F.count("*").alias("members")).filter("members > 1").select("block", "h.v", "h.m", "h.other"), "hubs")
        pairs = left.join(hubs, "block").filter("root <> other").filter(_fit("n", "m")).select(F.col("sig").alias("u"), "v").distinct()
        pairs = scratch(pairs, "pairs")
        links.append(_similar(pairs, maps, texts))
        discard(hubs, pairs)
        if draw:
            discard(left)
        left = _rooted(blocks, links)
    mapped = scratch(left.join(maps.select("sig", "bits").hint("merge"), "sig"), "mapped")
    one, two = (mapped.select("block", F.col("sig").alias(c), F.col("root").alias(f"r{c}"), *_maps(mapped, c)) for c in "uv")
    every = one.join(two.hint("merge"), "block").filter("ru < rv").filter(_fit("nu", "nv")).filter(_near("u", "v"))
    found = scratch(every.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), "found")
    discard(left, mapped)
    links.append(_similar(found.distinct(), maps, texts))
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    roots = scratch(components(every).withColumnRenamed("node", "sig"), "roots")
    return rows.join(roots, "sig", "left").select("own", "digest", F.coalesce("root", "sig").alias("root"))
