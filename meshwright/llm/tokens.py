"""Vectorised word handling over Arrow batches.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; because those
separators are ASCII, splitting UTF-8 bytes and splitting code points agree.
``WordBatch`` finds the words of a whole Arrow batch with numpy and gives every
word a 64-bit polynomial hash from prefix sums, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SEPARATORS = bytes([0x20, *range(0x09, 0x0E)])
_IS_SEP = np.zeros(256, dtype=bool)
_IS_SEP[list(SEPARATORS)] = True
#: Bytes that are no ASCII letter or digit, or no ASCII letter; the bytes of other letters are neither.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
NOT_ALPHA = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_M64 = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    if n:
        out[0] = 1
        done = 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
    return out


_TABLES: dict[str, np.ndarray] = {"r": _powers(_R, 1 << 16), "i": _powers(_RINV, 1 << 16)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_TABLES[kind]) < n:
        _TABLES[kind] = _powers(_R if kind == "r" else _RINV, max(n, 2 * len(_TABLES[kind])))
    return _TABLES[kind]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def string_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its int64 row offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    base = int(offsets[0])
    size = int(offsets[-1]) - base
    buf = np.frombuffer(data, np.uint8)[base : base + size] if size else np.zeros(0, np.uint8)
    return buf, offsets - base


class WordBatch:
    """Words of a string column: ``start``/``end`` byte positions, ``first`` word of each row, ``hash``.

    ``apart`` marks the bytes between words; by default ASCII white space.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, lower: bool = False, apart: np.ndarray = _IS_SEP) -> None:
        buf, self.offsets = string_buffer(column)
        self.buf = _LOWER[buf] if lower else buf
        n = len(buf)
        inside = ~apart[buf]
        cut = np.zeros(n + 1, dtype=bool)
        cut[self.offsets] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | cut[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | cut[1:])) + 1
        #: first[d]..first[d + 1] are the words of row d
        self.first = np.searchsorted(self.start, self.offsets)
        self._hash: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            n = len(self.buf)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _table("r", n)[:n], out=sums[1:])
            self._hash = mix64((sums[self.end] - sums[self.start]) * _table("i", n + 1)[self.start])
        return self._hash

    def word(self, k: int) -> bytes:
        return self.buf[self.start[k] : self.end[k]].tobytes()

    def windows(self, size: int) -> np.ndarray:
        """Indices of words at which ``size`` consecutive words of one row start."""
        k = np.arange(max(0, len(self) - size + 1))
        row = self.row
        return k[row[k] == row[k + size - 1]] if len(k) else k


def rolling(values: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive values."""
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * _table("r", len(values))[: len(values)], out=sums[1:])
    return mix64((sums[size:] - sums[:-size]) * _table("i", n)[:n])
