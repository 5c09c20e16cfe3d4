"""Once-seen and twice-seen Bloom filters over 64-bit hashes.

``suspected`` cuts the hash space into ranges, as many as the input needs, each
with a pair of filters of one fixed size. The task that owns a range puts each
hash that arrives into the once-seen filter, or into the twice-seen one if it is
there already. Then the hashes meet the twice-seen filter of their range, and
those that it knows come back with their keys. Nothing is broadcast, no filter
fills up as the input grows, and whole keys of rows never shuffle here: a hash
is 8 bytes. A hash that a third of all rows hold arrives at most twice for each
block of a task, and the test of its range is dealt to several tasks.

``repeat_filter`` is the smaller form, one pair of filters for everything, for
uses to which false alarms only mean more work.

Every task fills a private pair with the hashes of its rows; a hash counts once
for a document. Only the chunks that hold a bit leave a task. Merging
two pairs keeps ``twice = twice1 | twice2 | (once1 & once2)``, so a hash that two
documents hold always tests as twice-seen. The rest is false alarms, which an
exact count on the few suspects removes later.

The merged twice-seen filter is the one thing that is broadcast. Its size is a
parameter with a hard upper bound (``MAX_BITS``): with more hashes than it was
made for the share of false alarms rises, and with it what is counted exactly,
but nothing gets lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, routed, routed_runs, schema, scratch, table
from .tokens import mix64

MIN_BITS, MAX_BITS = 1 << 20, 1 << 28
CHUNK = 1 << 16  # bytes
PART = "chunk:long once:binary twice:binary"


def filter_bits(expected: int) -> int:
    """About 12 bits for each expected hash, a power of two between MIN_BITS and MAX_BITS."""
    bits = MIN_BITS
    while bits < 12 * expected and bits < MAX_BITS:
        bits *= 2
    return bits


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit positions for each hash; the second comes from a second mix."""
    m = np.uint64(bits - 1)
    return hashes & m, mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)) & m


class RepeatFilter:
    """The twice-seen filter as the tasks test it."""

    def __init__(self, data: bytes | np.ndarray) -> None:
        self.data = np.frombuffer(data, np.uint8)
        self.bits = 8 * len(self.data)

    def test(self, hashes: np.ndarray) -> np.ndarray:
        a, b = _slots(hashes, self.bits)
        hit = (self.data[a >> np.uint64(3)] >> (a & np.uint64(7)).astype(np.uint8)) & 1 != 0
        at = np.flatnonzero(hit)
        b = b[at]
        hit[at] = (self.data[b >> np.uint64(3)] >> (b & np.uint64(7)).astype(np.uint8)) & 1 != 0
        return hit


def _build(distinct: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, twice = (np.zeros(bits // 8, np.uint8) for _ in range(2))

        def add(slots: np.ndarray) -> None:
            seen = np.sort(slots)
            again = seen[1:][seen[1:] == seen[:-1]]
            new = seen[np.r_[True, seen[1:] != seen[:-1]]] if len(seen) else seen
            byte, bit = new >> np.uint64(3), np.uint8(1) << (new & np.uint64(7)).astype(np.uint8)
            old = new[(once[byte] & bit) != 0]
            for filled, at in ((once, new), (twice, old), (twice, again)):
                np.bitwise_or.at(filled, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

        for hashes in distinct(batches):
            a, b = _slots(hashes, bits)
            add(a)
            add(b)
        step = min(CHUNK, bits // 8)
        for chunk in range(bits // 8 // step):
            part = slice(chunk * step, (chunk + 1) * step)
            if once[part].any():
                yield table(PART, [chunk], [zlib.compress(once[part].tobytes(), 1)], [zlib.compress(twice[part].tobytes(), 1)])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk to one row a chunk, its twice-seen bits; one chunk is in memory at a time."""
    at = once = twice = None
    for batch in batches:
        for chunk, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            if chunk == at:
                twice |= b | (once & a)
                once |= a
            else:
                if at is not None:
                    yield table("chunk:long twice:binary", [at], [zlib.compress(twice.tobytes(), 1)])
                at, once, twice = chunk, a.copy(), b.copy()
    if at is not None:
        yield table("chunk:long twice:binary", [at], [zlib.compress(twice.tobytes(), 1)])


def repeat_filter(rows: DataFrame, distinct: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int) -> bytes:
    """The twice-seen filter of all hashes that ``distinct`` yields, an array for each bounded piece.

    ``distinct`` must yield a hash once for each document that holds it. The
    filter comes to the driver, ``bits`` / 8 bytes at most.
    """
    parts = rows.transform(arrow_map, _build(distinct, bits), schema(PART))
    merged = parts.repartition("chunk").sortWithinPartitions("chunk").transform(arrow_map, _merge, schema("chunk:long twice:binary"))
    data = np.zeros(bits // 8, np.uint8)
    step = min(CHUNK, bits // 8)
    for row in merged.collect():
        data[row.chunk * step : (row.chunk + 1) * step] = np.frombuffer(zlib.decompress(bytes(row.twice)), np.uint8)
    return data.tobytes()


# -- filters by range -----------------------------------------------------------------------------------------------
PART_BITS = 1 << 24
PER_HASH, PROBES = 12, 4
HELD = 1 << 19  # hashes that a task gathers into one set of blocks
TESTED = 1 << 22  # hashes that one task tests against a range's filter
BLOCK = "group:long n:long keys:binary hashes:binary"


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Bit positions that don't depend on the range, double hashing."""
    a, m = mix64(hashes ^ np.uint64(0x5851F42D4C957F2D)), np.uint64(bits - 1)
    b = (a >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (a + np.uint64(k) * b) & m


def _holds(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), dtype=bool)
    for at in _probes(hashes, len(bits)):
        out &= bits[at]
    return out


def _put(bits: np.ndarray, hashes: np.ndarray) -> None:
    for at in _probes(hashes, len(bits)):
        bits[at] = True


def _blocks(hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], parts: int):
    """Keys and hashes in blocks by range, sorted by hash."""

    def out(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k, h = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        k, h = k[order], h[order]
        part = ((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        for at in range(0, len(first), 4096):
            own = first[at : at + 4096]
            ends = np.r_[first[at + 1 : at + 4097], len(h)][: len(own)]
            yield table(BLOCK, part[own].astype(np.int64), ends - own, *([x[a:b].tobytes() for a, b in zip(own, ends, strict=True)] for x in (k, h)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for k, h in hashes(batches):
            if len(h):
                held.append((k.astype(np.int64, copy=False), h))
                n += len(h)
            if n >= HELD:
                yield from out(held)
                held, n = [], 0
        if held:
            yield from out(held)

    return run


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with each hash once, or twice if it stands there more often."""
    for batch in batches:
        out = []
        for raw in batch.column(1).to_pylist():
            h, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
            out.append(np.concatenate([h, h[n > 1]]).tobytes())
        yield table("group:long hashes:binary", batch.column(0), out)


def _fill(bits: int):
    """The twice-seen filter of every range, from rows sorted by range."""

    def out(group: int, twice: np.ndarray) -> Iterator[pa.RecordBatch]:
        if twice.any():
            yield table("group:long twice:binary", [group], [zlib.compress(np.packbits(twice).tobytes(), 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, twice = None, np.zeros(bits, dtype=bool), np.zeros(bits, dtype=bool)
        for batch in batches:
            for group, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if group != at:
                    if at is not None:
                        yield from out(at, twice)
                    at = group
                    once[:] = twice[:] = False
                h, n = np.unique(np.frombuffer(raw, np.uint64), return_counts=True)
                _put(twice, h[(n > 1) | _holds(once, h)])
                _put(once, h)
        if at is not None:
            yield from out(at, twice)

    return run


def _test(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = None
        for _, kind, part in routed_runs(batches):
            if kind == 0:
                twice = np.unpackbits(np.frombuffer(zlib.decompress(part.column(0)[0].as_py()), np.uint8), count=bits).astype(bool)
                continue
            for k, h in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                h = np.frombuffer(h, np.uint64)
                hit = _holds(twice, h)
                if hit.any():
                    yield table("key:long hash:long", np.frombuffer(k, np.int64)[hit], h[hit].view(np.int64))

    return run


def suspected(rows: DataFrame, hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], expected: int, part_bits: int = PART_BITS) -> DataFrame:
    """``(key, hash)``, a scratch table: the hashes that two rows hold or that look so, once for each row.

    ``hashes`` yields for bounded pieces of ``rows`` arrays of keys and of hashes, a
    hash once for a row; ``expected`` is how many it yields, about or at most, and
    sets the number of ranges, not the size of a filter. No rows give an empty table.
    """
    parts = max(1, -(-PER_HASH * expected // part_bits))
    blocks = scratch(rows.transform(arrow_map, _blocks(hashes, parts), schema(BLOCK)), "blocks")
    thin = blocks.select("group", "hashes").transform(arrow_map, _thin, "group long, hashes binary")
    twice = scratch(thin.repartition("group").sortWithinPartitions("group").transform(arrow_map, _fill(part_bits), "group long, twice binary"), "twice")
    met, plan = routed(twice, blocks, F.lit(1), 1, F.col("n"), TESTED)
    out = scratch(met.transform(arrow_map, _test(part_bits), "key long, hash long"), "suspects")
    discard(blocks, twice, plan)
    return out
