"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: words, pairs of neighbours and pairs with one
word between, hashed into ``2 ** BITS`` slots. Every slot has its own learning
rate, and the L1 term keeps slots at exactly zero until the gradients insist, so
the weights that go to the executors are few: (slot, weight) pairs, at most one
for each slot.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, pieces, scratch, table
from .tokens import NOT_ALNUM, WordBatch, mix64

BITS = 20
#: The classifier learns from at most so many labelled ids, those with the least hash, and at least LABEL_ROWS of each label if there are so many,
SAMPLE_ROWS, LABEL_ROWS = 8000, 200
#: and at most so many bytes of their texts: each label has its share of them, and its first text always counts.
SAMPLE_BYTES = 48 << 20
SCORE = "id:long score:double"


def features(batch: WordBatch) -> list[np.ndarray]:
    """The distinct slots of every row."""
    h, row = batch.hash, batch.row
    shift = np.uint64(64 - BITS)

    def slots(gram: np.ndarray, kind: int) -> np.ndarray:
        return (mix64(gram + np.uint64(kind)) >> shift).astype(np.int64)

    own = [(row, slots(h, 1))]
    for gap in (1, 2):
        if len(h) > gap:
            a, b = h[:-gap], h[gap:]
            same = row[:-gap] == row[gap:]
            own.append((row[:-gap][same], slots((a * np.uint64(0x9E3779B97F4A7C15) ^ b)[same], 1 + gap)))
    rows, cols = (np.concatenate(x) for x in zip(*own, strict=True))
    pairs = np.unique((rows.astype(np.int64) << BITS) | cols)
    rows, cols = pairs >> BITS, pairs & ((1 << BITS) - 1)
    cut = np.searchsorted(rows, np.arange(1, len(batch.offsets) - 1))
    return np.split(cols, cut)


@dataclass
class Model:
    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS)
        out[self.slots] = self.weights
        return out


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = 3, alpha: float = 4.0, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1) -> Model:
    """FTRL-proximal over (slots, label) rows in the given order; without both labels the model only knows the prior."""
    n_pos = sum(y for _, y in rows)
    if not 0 < n_pos < len(rows):
        return Model(np.zeros(0, np.int64), np.zeros(0), 30.0 if n_pos else -30.0)
    bias0 = float(np.log(n_pos / (len(rows) - n_pos)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    zb = nb = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = weight(zx, nx)
            wb = -zb / ((beta + np.sqrt(nb)) / alpha)
            p = 1 / (1 + np.exp(-np.clip(bias0 + wb + w.sum(), -30, 30)))
            g = p - y
            step = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - step * w
            n[x] = nx + g * g
            zb += g - (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha * wb
            nb += g * g
    w = weight(z, n)
    slots = np.flatnonzero(w)
    return Model(slots, w[slots], bias0 - zb / ((beta + np.sqrt(nb)) / alpha))


#: Settings to choose from; the defaults of ``fit`` are what ``choose`` took on the training rows of sf0.1.
GRID = [(alpha, l1) for alpha in (0.5, 1.0, 2.0, 4.0, 8.0) for l1 in (1.0, 3.0, 6.0, 10.0)]


def choose(rows: list[tuple[int, np.ndarray, int]], grid: list[tuple[float, float]] = GRID) -> tuple[float, float]:
    """(alpha, l1) of least log loss on a third of training rows ``(id, slots, label)``, fitted on the others.

    The third is drawn by a hash of the id; held-out rows must not be among them.
    """
    judges = [zlib.crc32(b"judge%d" % i) % 3 == 0 for i, _, _ in rows]
    fitted = [(x, y) for (_, x, y), j in zip(rows, judges, strict=True) if not j]

    def loss(alpha: float, l1: float) -> float:
        m = fit(fitted, alpha=alpha, l1=l1)
        w = m.dense()
        s = np.array([np.clip(m.bias + w[x].sum(), -30, 30) * (1 if y else -1) for (_, x, y), j in zip(rows, judges, strict=True) if j])
        return float(np.log1p(np.exp(-s)).mean()) if len(s) else 0.0

    return min(grid, key=lambda g: loss(*g))


def _text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(df[id_col].cast("long").alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def fitting(rows: list[tuple[int, int, int]], sample_bytes: int) -> list[tuple[int, int]]:
    """(id, label, bytes) in order to the (id, label) whose texts fit: each label has its share of the bytes, and its smallest text fits."""
    out = []
    total = sum(n for *_, n in rows)
    for label in (0, 1):
        own = [(i, n) for i, y, n in rows if y == label]
        left = sample_bytes * sum(n for _, n in own) // total if total > sample_bytes else total
        taken = []
        for i, n in own:
            if n <= left:
                taken.append((i, label))
                left -= n
        out += taken or [(min(own, key=lambda x: x[1])[0], label)] if own else []
    return out


def spark_rows(spark: SparkSession, rows: list[tuple[int, int]]) -> DataFrame:
    return spark.createDataFrame(pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "y": pa.array([y for _, y in rows], pa.int32())}))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a bounded sample of the labelled documents outside the held-out fifth.

    ``sample_rows`` ids are drawn by a hash, LABEL_ROWS of each label at least; each
    label takes texts in that order up to its share of ``sample_bytes``, skipping
    those that are larger than what is left, and its smallest text in any case, so
    no length of text leaves a label out. Labels other than 0 and 1 are ignored; of
    several for one id the largest counts. No labels, an empty table or labels of one
    kind give a model of the prior. The sample's ids are broadcast, 8 bytes each; its
    features come to the driver.
    """
    marks = labels.select(labels[id_col].cast("long").alias("id"), labels[label_col].cast("int").alias("y")).filter("y in (0, 1) and id is not null").filter(~held_out(F.col("id")))
    marks = scratch(marks.groupBy("id").agg(F.max("y").alias("y")), "labels")
    drawn = lambda df, n: df.orderBy(F.xxhash64("id"), "id").limit(n)
    some = drawn(marks, sample_rows)
    for y in (0, 1):
        some = some.union(drawn(marks.filter(F.col("y") == y), min(LABEL_ROWS, sample_rows)))
    some = scratch(some.distinct(), "drawn")
    sizes = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).alias("bytes")).join(F.broadcast(some), "id")
    sizes = sizes.groupBy("id", "y").agg(F.sum("bytes").alias("bytes"))
    marks = spark_rows(docs.sparkSession, fitting([(r["id"], r["y"], r["bytes"]) for r in sizes.orderBy(F.xxhash64("id"), "id").collect()], sample_bytes))
    rows = _text(docs, id_col, text_col).join(F.broadcast(marks), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            f = [x.astype(np.int32).tobytes() for x in features(WordBatch(piece.column(1), lower=True, apart=NOT_ALNUM))]
            yield table("id:long y:int x:binary", piece.column(0), piece.column(2), f)

    found = rows.transform(arrow_map, run, "id long, y int, x binary").toArrow()
    found = sorted(zip(*(c.to_pylist() for c in found.columns), strict=True), key=lambda r: (int(mix64(np.array([r[0]], np.int64).view(np.uint64))[0]), r[2]))
    return fit([(np.frombuffer(x, np.int32), y) for _, y, x in found])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row, 0 to 1, the same for equal texts.

    A null or empty text has no feature and scores the prior; a text of any length
    is scored whole; null and repeated ids stay as they are; an empty table gives an
    empty one. Other columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        w = m.dense()
        for piece in pieces(batches, "text"):
            sums = np.array([w[x].sum() for x in features(WordBatch(piece.column(1), lower=True, apart=NOT_ALNUM))])
            yield table(SCORE, piece.column(0), 1 / (1 + np.exp(-np.clip(m.bias + sums, -30, 30))))

    return _text(docs, id_col, text_col).transform(arrow_map, run, "id long, score double")


def held_out(id_col):
    """Whether a document is kept from training."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
