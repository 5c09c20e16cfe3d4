"""Language ID by unigram models over a fixed public vocabulary, summed over all segmentations.

A word's probability under a language is the sum, over every way to cut it into
vocabulary pieces, of the product of the pieces' probabilities. The forward
algorithm gives that sum without listing the cuts, the backward algorithm the
expected piece counts from which EM learns a language's probabilities. Words do
not depend on each other, so a text's score is the sum over its words, and all
distinct words of a batch go through the recursion together as matrix columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, pieces, schema, scratch, table
from .tokens import NOT_ALPHA, WordBatch, mix64

#: The model learns from at most so many rows a language, those with the least hash of id and text, and so many bytes of them.
SAMPLE_ROWS, SAMPLE_BYTES = 300, 8 << 20
LONGEST_PIECE, LONGEST_WORD = 12, 48
KNOWN_WORDS = 1 << 16
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_R = np.uint64(0x9E3779B97F4A7C15)
_RINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
UNDETERMINED = "und"


def read_pieces(path: str = VOCABULARY) -> list[str]:
    """The text pieces of a sentencepiece vocabulary, in lower case, up to LONGEST_PIECE characters."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=str(Path(path)))
    found = {sp.id_to_piece(k) for k in range(sp.get_piece_size()) if not (sp.is_control(k) or sp.is_unknown(k) or sp.is_byte(k))}
    return sorted({p.lower() for p in found if 0 < len(p.lower()) <= LONGEST_PIECE})


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words as a zero-padded matrix, and the words' lengths."""
    size = np.array([len(w) for w in words], dtype=np.int64)
    width = int(size.max(initial=0))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), width).astype(np.uint64), size


class Pieces:
    """The pieces' hashes, sorted; a table of their first bits rules out nearly all other strings at once."""

    BITS = 20

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = hashes
        self.shift = np.uint64(64 - self.BITS)
        self.maybe = np.zeros(1 << self.BITS, dtype=bool)
        self.maybe[hashes >> self.shift] = True

    def find(self, h: np.ndarray, fits: np.ndarray) -> np.ndarray:
        """The number of the piece with each hash that fits, else the number of pieces."""
        out = np.full(h.shape, len(self.hashes))
        on = fits & self.maybe[h >> self.shift]
        h = h[on]
        at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
        out[on] = np.where(self.hashes[at] == h, at, len(self.hashes))
        return out


class Lattice:
    """For a batch of words: which piece, if any, spans each (start, length)."""

    def __init__(self, known: Pieces, words: list[str]) -> None:
        codes, self.size = _codes(words)
        n, width = codes.shape
        up, down = np.full(width + 1, _R), np.full(width + 1, _RINV)
        up[0] = down[0] = 1
        np.cumprod(up, out=up)
        np.cumprod(down, out=down)
        sums = np.zeros((n, width + 1), np.uint64)
        np.cumsum(codes * up[:width], axis=1, out=sums[:, 1:])
        self.width, self.none = width, len(known.hashes)
        #: piece[length][:, start] is the piece's number, or ``none``
        self.piece: dict[int, np.ndarray] = {}
        for length in range(1, min(LONGEST_PIECE, width) + 1):
            h = mix64((sums[:, length:] - sums[:, :-length]) * down[: width + 1 - length])
            self.piece[length] = known.find(h, np.arange(width + 1 - length)[None, :] + length <= self.size[:, None])


def piece_hash(piece: str) -> int:
    total, power = 0, 1
    for c in piece:
        total = (total + ord(c) * power) & ((1 << 64) - 1)
        power = power * int(_R) & ((1 << 64) - 1)
    return int(mix64(np.array([total], np.uint64))[0])


@dataclass
class Model:
    """``hashes`` of the pieces in order, and ``prob``: a row a piece and a last one of zeros, a column a language."""

    hashes: np.ndarray
    prob: np.ndarray
    langs: list[str]
    unknown: float  # probability of a character that no piece matches
    #: Hashes of frequent words of the sample, sorted, and their log probabilities, so that no task computes them again.
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    logs: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))

    @cached_property
    def pieces(self) -> Pieces:
        return Pieces(self.hashes)

    @cached_property
    def scorer(self) -> Scorer:
        """One for all tasks of a Python worker."""
        return Scorer(self)

    def know(self, words: list[str]) -> Model:
        """Remember the scores of whole words that need no cutting."""
        batch = _batch(pa.array(words, pa.string()))
        plain = [k for k, n in enumerate(batch.counts) if n == 1 and len(words[k]) < LONGEST_WORD and words[k].encode() == batch.word(batch.first[k])]
        h = batch.hash[batch.first[:-1][plain]] if plain else np.zeros(0, np.uint64)
        logs = self.log_probability([SPACE + words[k] for k in plain]).astype(np.float32)
        self.words, first = np.unique(h, return_index=True)
        self.logs = logs[first]
        return self

    def forward(self, lattice: Lattice) -> np.ndarray:
        """alpha[position] (words x languages): the summed probability of all cuts of the first characters."""
        n, width = len(lattice.size), lattice.width
        alpha = np.zeros((width + 1, n, self.prob.shape[1]))
        alpha[0] = 1
        for end in range(1, width + 1):
            for length, found in lattice.piece.items():
                if length <= end:
                    p = self.prob[found[:, end - length]]
                    if length == 1:
                        p = np.maximum(p, self.unknown)
                    alpha[end] += alpha[end - length] * p
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """log P(word | language), words x languages; every word of at most LONGEST_WORD characters."""
        out = np.empty((len(words), len(self.langs)))
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(order), 2048):  # words of like length together
            own = order[at : at + 2048]
            lattice = Lattice(self.pieces, [words[k] for k in own])
            out[own] = np.log(self.forward(lattice)[lattice.size, np.arange(len(own))])
        return out


def fit(counts: dict[str, dict[str, int]], vocabulary: list[str], rounds: int = 4, smooth: float = 0.05) -> Model:
    """EM over word counts by language; every piece keeps a little probability in every language."""
    hashes = np.array([piece_hash(p) for p in vocabulary], dtype=np.uint64)
    hashes = np.unique(hashes)
    langs = sorted(counts)
    words = sorted({w for c in counts.values() for w in c}, key=lambda w: (len(w), w))
    weight = np.array([[counts[g].get(w, 0) for g in langs] for w in words], dtype=float).reshape(len(words), len(langs))
    model = Model(hashes, np.vstack([np.full((len(hashes), len(langs)), 1 / len(hashes)), np.zeros((1, len(langs)))]), langs, 1e-6)
    for _ in range(rounds if langs else 0):
        expected = np.full((len(hashes) + 1, len(langs)), smooth)
        for at in range(0, len(words), 2048):
            lattice = Lattice(model.pieces, words[at : at + 2048])
            n, width = len(lattice.size), lattice.width
            alpha = model.forward(lattice)
            beta = np.zeros_like(alpha)
            beta[lattice.size, np.arange(n)] = 1
            for start in range(width - 1, -1, -1):
                for length, found in lattice.piece.items():
                    if start + length <= width:
                        p = model.prob[found[:, start]]
                        beta[start] += (np.maximum(p, model.unknown) if length == 1 else p) * beta[start + length]
            share = weight[at : at + n] / beta[0]
            at_piece, add = [], []
            for length, found in lattice.piece.items():
                hit, start = np.nonzero(found != lattice.none)
                own = found[hit, start]
                at_piece.append(own)
                add.append(alpha[start, hit] * model.prob[own] * beta[start + length, hit] * share[hit])
            if at_piece:
                at_piece, add = np.concatenate(at_piece), np.concatenate(add)
                for g in range(len(langs)):
                    expected[:, g] += np.bincount(at_piece, add[:, g], len(expected))
        expected[-1] = 0
        model.prob = expected / expected.sum(axis=0)
    return model


# -- texts ----------------------------------------------------------------------------------------------------------
def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _batch(column: pa.Array) -> WordBatch:
    return WordBatch(pc.utf8_lower(column.cast(pa.string())), apart=NOT_ALPHA)


def _runs(word: bytes) -> list[str]:
    """A word as the models see it: behind the mark of a word's begin; longer ones in runs of LONGEST_WORD."""
    text = SPACE + word.decode("utf-8", "replace")
    return [text[k : k + LONGEST_WORD] for k in range(0, len(text), LONGEST_WORD)]


class Scorer:
    """Scores batches, and keeps what it knows of the most recent ``keep`` distinct words."""

    def __init__(self, model: Model, keep: int = 1 << 19) -> None:
        self.model, self.keep = model, keep
        self.known = model.words
        self.value = model.logs.reshape(len(model.words), len(model.langs))

    def __call__(self, batch: WordBatch) -> np.ndarray:
        """log P(text | language), rows x languages."""
        h, first, inverse = np.unique(batch.hash, return_index=True, return_inverse=True)
        value = np.zeros((len(h), len(self.model.langs)), np.float32)
        at = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        old = self.known[at] == h if len(self.known) else np.zeros(len(h), bool)
        value[old] = self.value[at[old]]
        new = np.flatnonzero(~old)
        runs = [_runs(batch.word(first[k])) for k in new]
        flat = [r for x in runs for r in x]
        if flat:
            logs = self.model.log_probability(flat)
            value[new] = np.add.reduceat(logs, np.r_[0, np.cumsum([len(x) for x in runs])[:-1]], axis=0)
            if len(self.known) + len(new) > self.keep:  # begin anew with what is certain to be of use
                self.known, self.value = h, value
            else:
                known = np.r_[self.known, h[new]]
                order = np.argsort(known)
                self.known, self.value = known[order], np.vstack([self.value, value[new]])[order]
        sums = np.zeros((len(batch) + 1, value.shape[1]))
        np.cumsum(value[inverse], axis=0, dtype=np.float64, out=sums[1:])
        return sums[batch.first[1:]] - sums[batch.first[:-1]]


def held_out(id_col: Column) -> Column:
    """Whether a document is kept from training."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on rows with a language outside the held-out quarter, for each language a bounded sample in the order of a hash of id and text.

    Rows without text or language teach nothing; equal rows stand together in the
    order, each counts; a language whose first text is over the bound learns from
    that text alone. An empty table gives a model without languages.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"), docs[lang_col].cast("string").alias("lang")).filter("text is not null and lang is not null")
    rows = rows.filter(~held_out(F.col("id"))).select("text", "lang", F.xxhash64("id", "text").alias("order"), F.octet_length("text").alias("bytes"))
    sizes = scratch(rows.groupBy("lang").agg(F.count("*").alias("n")), "langs")
    # thin each language out by hash first, so that no task ranks more than about four times the sample
    rows = rows.join(sizes, "lang")
    near = rows.filter((F.col("n") <= 4 * sample_rows) | (F.pmod("order", F.lit(1 << 30)) * F.col("n") < (4 * sample_rows) * float(1 << 30)))
    w = Window.partitionBy("lang").orderBy("order", "text")
    near = near.withColumn("k", F.row_number().over(w)).withColumn("sum", F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sample = near.filter((F.col("k") <= sample_rows) & ((F.col("sum") <= sample_bytes) | (F.col("k") == 1))).select("lang", "text")
    counts: dict[str, dict[str, int]] = {}
    for row in sample.collect():
        own = counts.setdefault(row.lang, {})
        for part in pieces(iter([pa.RecordBatch.from_arrays([pa.array([row.text])], names=["text"])]), "text"):
            batch = _batch(part.column(0))
            h, first, n = np.unique(batch.hash, return_index=True, return_counts=True)
            for k, c in zip(first, n, strict=True):
                for r in _runs(batch.word(k)):
                    own[r] = own.get(r, 0) + int(c)
    model = fit(counts, read_pieces(vocabulary))
    total: dict[str, int] = {}
    for own in counts.values():
        for run, n in own.items():
            if run.startswith(SPACE):
                total[run[1:]] = total.get(run[1:], 0) + n
    return model.know(sorted(total, key=lambda w: (-total[w], w))[:KNOWN_WORDS]) if model.langs else model


PREDICTED = "id:long lang_pred:string score:double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """``id, lang_pred, score`` of every row.

    ``score`` is the probability of the predicted language among the learned ones,
    all equally likely beforehand; of languages that tie the first by code point
    wins. A text of any length is scored whole; an empty table gives an empty one. A text that is null or has no letter is ``und``
    with score 0, and so is every text if no language was learned. Null and
    repeated ids stay as they are. With ``carry`` a struct ``row`` of all columns
    of ``docs`` comes along.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for piece in pieces(batches, "text"):
            texts = piece.column(1)
            batch = _batch(texts.fill_null(""))
            logs = m.scorer(batch) if m.langs else np.zeros((len(texts), 1))
            best = logs.argmax(axis=1)
            score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
            plain = np.array([bool(m.langs) and t is not None and has_letter(t) for t in texts.to_pylist()], dtype=bool)
            names = [m.langs[b] if ok else UNDETERMINED for b, ok in zip(best, plain, strict=True)]
            out = table(PREDICTED, piece.column(0), names, np.where(plain, score, 0.0))
            yield out.append_column("row", piece.column(2)) if carry else out

    columns = [docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")]
    rows = docs.select(*columns, F.struct(*(docs[c] for c in docs.columns)).alias("row")) if carry else docs.select(*columns)
    kind = T.StructType.fromDDL(schema(PREDICTED))
    return rows.transform(arrow_map, run, kind.add("row", rows.schema["row"].dataType) if carry else kind)
