"""Toxicity by multiple-instance learning: sentences are scored, noisy-or makes the document's score.

A sentence ends at one of . ! ? or a line end. Its score is z = BIAS + the weights of its words, p = sigmoid(z); a
document is toxic with probability 1 - prod(1 - p), which is 1 - exp(-sum softplus(z)). Only sentences that say something count in
that sum: in the fit those that hold a word or stem that may get a weight, in the score those whose weights sum above 0.
A word (lower-cased; punctuation reads as space) carries the weights of its own bucket and of the prefixes that it goes on after,
so an unseen ending of a known stem counts.
Only documents carry labels: the gradient of the document likelihood reaches each sentence in proportion to its share of the
blame. Offending sentences are those with p of at least one half, or the likeliest one of a document that is toxic without them.
Weights of stems and words are 0 or more, those of harmless words with a toxic stem 0 or less. Sentences without a weighted word,
empty ones included, add nothing, so a text without any scores 0, however long it is.
Sentences with p below one half are weak evidence, and clean prose holds some: what its words bring on average is learnt from the clean
documents of the sample, and a text's weak evidence counts only beyond EXCUSED times that. So a clean text stays clean at any length,
while a sentence that is toxic by itself always counts.

The model is fitted on the driver from a bounded sample (about PER_CLASS toxic and twice as many other documents, of at most
TRAIN_BYTES each); scoring is one pass over whole texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import LETTERS, bounded_sample, padded, span_hashes, text_slices, word_spans

PREFIXES = (4, 5, 6, 7, 8, 9, 10, 12)  # bytes
BITS, BIAS, PENALTY = 20, -10.0, 1e-3
PER_CLASS = 1500  # training documents a class, at most about
TRAIN_BYTES = 16_384  # longest text of the training sample
EXCUSED = 2.0  # times the weak evidence that clean prose of the same length holds
FEATURES = 3000  # buckets with a weight
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[10, 33, 46, 63]] = True


@dataclass(frozen=True)
class Model:
    buckets: np.ndarray
    weights: np.ndarray
    background: float = 0.0  # weak evidence a word of clean text

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


_LUT = np.frombuffer(LETTERS, np.uint8)
_GAP = _LUT == 32


@dataclass(frozen=True)
class _Slice:
    """Sentences and distinct words of a slice of texts."""

    buf: bytes
    first: np.ndarray  # first byte of each sentence
    docs: np.ndarray  # first sentence of each document
    word: np.ndarray  # distinct word of each word
    sentence: np.ndarray  # sentence of each word
    buckets: np.ndarray  # distinct words x (1 + prefixes); -1: the word is no longer than the prefix


def _slice(raw: np.ndarray, offsets: np.ndarray) -> _Slice:
    buf, start = padded(raw, offsets, 1)
    data = np.frombuffer(buf, np.uint8)
    first = np.unique(np.concatenate((start - 1, np.flatnonzero(_ENDS[data[:-1]]) + 1)))  # the space before a text belongs to it
    a, b, _ = word_spans(data, np.array([0, len(data)]), _GAP)
    hashes, example, word = np.unique(span_hashes(data, a, b, _LUT), return_index=True, return_inverse=True)
    buckets = np.full((len(hashes), 1 + len(PREFIXES)), -1, dtype=np.int64)
    shift = np.uint64(64 - BITS)
    buckets[:, 0] = hashes >> shift
    for k, size in enumerate(PREFIXES, 1):
        goes_on = np.flatnonzero(b[example] - a[example] > size)
        at = a[example[goes_on]]
        buckets[goes_on, k] = (span_hashes(data, at, at + size, _LUT) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    return _Slice(buf, first, np.searchsorted(first, start - 1), word, np.searchsorted(first, a, side="right") - 1, buckets)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def fit_texts(texts: list[str], toxic: np.ndarray) -> Model:
    """Model of document labels (0/1). Without one of the classes no weight is learnt and all scores are near 0."""
    empty = Model(np.zeros(0, np.int64), np.zeros(0, np.float32))
    if not len(texts) or toxic.min() == toxic.max():
        return empty
    column, seen = pa.array(texts, pa.large_string()), np.zeros((2, 1 << BITS), dtype=np.int32)
    for at, n, raw, off in text_slices(column):
        x = _slice(raw, off)
        doc = np.searchsorted(x.docs, x.sentence, side="right") - 1
        pairs = np.unique(doc * len(x.buckets) + x.word)
        doc, held = pairs // len(x.buckets), x.buckets[pairs % len(x.buckets)]
        for y in (0, 1):
            mine = toxic[at + doc] == y
            each = np.unique(doc[mine][:, None] * (1 << BITS) + np.where(held[mine] >= 0, held[mine], 0))
            np.add.at(seen[y], each & ((1 << BITS) - 1), 1)
    n0, n1 = int((toxic == 0).sum()), int((toxic == 1).sum())
    p0, p1 = (seen[0] + 0.5) / (n0 + 1), (seen[1] + 0.5) / (n1 + 1)
    gain = np.where((seen[1] >= 3) & (p1 > 2 * p0), p1 * np.log(p1 / p0), 0.0)
    gain[0] = 0.0  # stands for no prefix
    chosen = np.argsort(-gain, kind="stable")[:FEATURES]
    chosen = chosen[gain[chosen] > 0]
    if not len(chosen):
        return empty
    number = np.full(1 << BITS, -1, dtype=np.int64)
    number[chosen] = np.arange(len(chosen))
    parts, positive = [_slice(raw, off) for _, _, raw, off in text_slices(column)], len(chosen)
    for x in parts:  # words with a chosen prefix that clean documents hold: the exceptions
        stem = (number[x.buckets[:, 1:]] >= 0) & (x.buckets[:, 1:] >= 0) & (number[x.buckets[:, 1:]] < positive)
        own = np.unique(x.buckets[stem.any(axis=1), 0])
        own = own[(number[own] < 0) & (seen[0, own] > 0)]
        number[own] = positive + np.arange(len(own)) + (len(chosen) - positive)
        chosen = np.concatenate((chosen, own))
    rows, cols, doc_of, sentences, at = [], [], [], 0, 0
    for x in parts:
        feature = np.where(x.buckets >= 0, number[x.buckets], -1)
        useful = np.flatnonzero((feature >= 0).any(axis=1)[x.word])
        f = feature[x.word[useful]]
        r, c = np.nonzero(f >= 0)
        rows.append(sentences + x.sentence[useful[r]])
        cols.append(f[r, c])
        doc_of.append(at + np.searchsorted(x.docs, np.arange(len(x.first)), side="right") - 1)
        sentences, at = sentences + len(x.first), at + len(x.docs)
    row, col, doc = np.concatenate(rows), np.concatenate(cols), np.concatenate(doc_of)
    speaks = np.bincount(row, minlength=sentences) > 0
    lowest, highest = np.where(np.arange(len(chosen)) < positive, 0.0, -np.inf), np.where(np.arange(len(chosen)) < positive, np.inf, 0.0)
    y, w, m, v = toxic.astype(float), np.where(lowest == 0, 0.1, 0.0), 0.0, 0.0
    share = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    for step in range(1, 401):  # Adam on the whole sample with an L1 penalty, each weight held on its side of 0
        z = BIAS + np.bincount(row, w[col], minlength=sentences)
        total = np.maximum(np.bincount(doc, np.where(speaks, _softplus(z), 0.0), minlength=len(y)), 1e-12)
        blame = np.where(y == 1, -1 / np.expm1(np.minimum(total, 50.0)), 1.0) * share
        grad = np.bincount(col, (blame[doc] / (1 + np.exp(-z)))[row], minlength=len(chosen)) / len(y) + np.where(lowest == 0, PENALTY, -PENALTY)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = np.clip(w - 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8), lowest, highest)
    keep = w != 0
    model = Model(chosen[keep], w[keep].astype(np.float32))
    table, weak, words, at = model.table(), 0.0, 0, 0
    for x in parts:
        clean = toxic[at : at + len(x.docs)] == 0
        _, mine, size = _evidence(x, table)[1:]
        weak, words, at = weak + float(mine[clean].sum()), words + int(size[clean].sum()), at + len(x.docs)
    return Model(model.buckets, model.weights, weak / max(words, 1))


def _evidence(x: _Slice, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """z of each sentence; each document's evidence from sentences toxic by themselves and from weaker ones, and its words."""
    weight = np.where(x.buckets >= 0, table[x.buckets], 0.0).sum(axis=1, dtype=np.float64)
    z = BIAS + np.bincount(x.sentence, weight[x.word], minlength=len(x.first))
    each = np.where(z > BIAS, _softplus(z), 0.0)
    doc = np.searchsorted(x.docs, x.sentence, side="right") - 1
    return z, np.add.reduceat(np.where(z >= 0, each, 0.0), x.docs), np.add.reduceat(np.where(z < 0, each, 0.0), x.docs), np.bincount(doc, minlength=len(x.docs))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from the labelled documents given (the caller leaves out what it holds out).

    Rows with a null id, text or label teach nothing, nor do texts above TRAIN_BYTES; of several labels of one id the largest counts.
    """
    short = docs.where(F.octet_length(F.col(text_col)) <= TRAIN_BYTES).select(F.col(id_col).alias("s_id")).distinct()  # before the draw: long texts take no one's place
    known = labels.select(F.col(id_col).alias("y_id"), F.col(label_col).cast("int").alias("y")).dropna().join(short, F.col("y_id") == F.col("s_id"), "left_semi")
    picked = bounded_sample(known.groupBy("y_id").agg(F.max("y").alias("y")), "y", {0: 2 * PER_CLASS, 1: PER_CLASS}, "y_id", seed=10)
    rows = (
        docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"))
        .where(F.octet_length("text") <= TRAIN_BYTES).join(F.broadcast(picked), F.col("d_id") == F.col("y_id"))
        .select("d_id", "text", "y").toArrow().sort_by([("d_id", "ascending"), ("text", "ascending")]))
    return fit_texts(rows["text"].to_pylist(), np.array(rows["y"].to_pylist(), dtype=np.int64))


def score_batch(column: pa.Array, table: np.ndarray, background: float = 0.0) -> tuple[np.ndarray, list[list[str]]]:
    """Noisy-or score of each text, and its offending sentences."""
    scores, found = [], []
    for _, n, raw, off in text_slices(column):
        x = _slice(raw, off)
        z, strong, weak, words = _evidence(x, table)
        score = -np.expm1(-(strong + np.maximum(0.0, weak - EXCUSED * background * words)))
        scores.append(score)
        doc = np.searchsorted(x.docs, np.arange(len(z)), side="right") - 1
        bad = set(np.flatnonzero(z >= 0).tolist())
        for d in set(np.flatnonzero(score >= 0.5).tolist()) - set(doc[sorted(bad)].tolist()):
            bad.add(int(x.docs[d] + np.argmax(z[x.docs[d] : x.docs[d + 1] if d + 1 < n else len(z)])))
        mine: list[list[str]] = [[] for _ in range(n)]
        for s in sorted(bad):
            end = x.first[s + 1] if s + 1 < len(x.first) else len(x.buf)
            mine[int(doc[s])].append(x.buf[x.first[s] : end].decode("utf-8", "replace").strip())
        found += mine
    return np.concatenate(scores) if scores else np.zeros(0), found


def _score(model: Model, keep_below: float | None, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        for batch in batches:
            score, found = score_batch(batch.column(text_at), table, model.background)
            score = np.round(np.clip(score, 0.0, 1.0), 6)
            if keep_below is not None:
                yield batch.filter(pa.array(score < keep_below))
                continue
            keep = [i for i in range(batch.num_columns) if i != text_at]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in keep), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(found, pa.list_(pa.string()))],
                names=names)
    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, offending sentences) of every row; null and empty texts score 0.

    Repeated rows score alike, ids may be null, and other columns (any names) are not read.
    """
    src = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"))
    out = T.StructType([src.schema["c0"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                        T.StructField("offending", T.ArrayType(T.StringType()))])
    return src.mapInArrow(_score(model, None, 1, out.names), out).withColumnRenamed("c0", id_col)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (all columns, any names) whose score is below ``threshold``; null and empty texts stay, equal rows share their fate."""
    return docs.mapInArrow(_score(model, threshold, docs.columns.index(text_col), []), docs.schema)
