"""Language identification in two levels: the language family first, then one-versus-one linear SVMs inside it.

Features are relative frequencies of byte 3-grams (lower-cased letters, everything else a space) in 2**BITS buckets, each
divided by the root of its mean frequency. A linear score is then a sum of table entries over a text's positions, so
whole texts are scored in one vectorised pass without a shuffle. The classifiers (squared-hinge linear SVMs, dual
coordinate descent) are fitted on the driver from at most SAMPLE documents of at most TRAIN_BYTES each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import LETTERS, bounded_sample, ngram_codes, padded, text_slices

GRAM, BITS = 3, 14
SAMPLE = 1600  # training documents in all, shared evenly by the languages
TRAIN_BYTES = 16_384
UNKNOWN = "und"
FAMILY_LEVEL = ""

# fixed values: families of languages by code; a code that is not listed is a family of its own
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "bg", "sr", "hr", "sl", "cs", "sk", "pl"),
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes}
_ASCII_LETTER = np.array([chr(b).isascii() and chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class Duel:
    """A linear classifier between two classes: positive margins speak for ``first``."""

    level: str  # FAMILY_LEVEL, or the family whose languages it tells apart
    first: str
    second: str
    bias: float
    sharpness: float


@dataclass(frozen=True)
class Model:
    families: dict[str, list[str]]  # family -> its learnt languages
    duels: list[Duel]
    tables: np.ndarray  # buckets x duels


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


def _frequencies(texts: list[str]) -> np.ndarray:
    out = np.zeros((len(texts), 1 << BITS), dtype=np.float32)
    for at, n, raw, off in text_slices(pa.array(texts, pa.large_string())):
        buf, start = padded(raw, off, GRAM)
        codes = ngram_codes(np.frombuffer(buf.translate(LETTERS), np.uint8), GRAM, BITS)
        cut = [*(start - 1).tolist(), len(codes)]
        for i in range(n):
            part = codes[cut[i] : cut[i + 1]]
            out[at + i] = np.bincount(part, minlength=1 << BITS) / len(part)
    return out


def _svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear SVM by dual coordinate descent on the Gram matrix; the bias is the weight of a constant last column."""
    gram = (x @ x.T).astype(np.float64) * np.outer(y, y)
    gram[np.diag_indices(len(y))] += 0.5 / cost
    alpha, slope = np.zeros(len(y)), np.full(len(y), -1.0)
    rng = np.random.default_rng(9)
    for _ in range(rounds):
        for i in rng.permutation(len(y)).tolist():
            step = max(-alpha[i], -slope[i] / gram[i, i])
            if step:
                alpha[i] += step
                slope += step * gram[i]
    return (x.T @ (alpha * y).astype(x.dtype)).astype(np.float64)


def fit_texts(texts: list[str], langs: list[str]) -> Model:
    """Model of the languages seen; with none, every prediction is ``und``."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    if not langs:
        return Model({}, [], np.zeros((1 << BITS, 0), np.float32))
    x = _frequencies(texts)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-7)
    x = np.concatenate((x * scale, np.ones((len(x), 1), np.float32)), axis=1).astype(np.float32)
    lang, fam = np.array(langs), np.array([family_of(v) for v in langs])
    duels, tables = [], []
    for level, names in [(FAMILY_LEVEL, sorted(families)), *families.items()]:
        labels = lang if level else fam
        for a, b in combinations(names, 2):
            rows = np.flatnonzero((labels == a) | (labels == b))
            w = _svm(x[rows], np.where(labels[rows] == a, 1.0, -1.0))
            margin = np.abs(x[rows] @ w).mean()
            duels.append(Duel(level, a, b, float(w[-1]), float(3 / max(margin, 1e-6))))
            tables.append((w[:-1] * scale).astype(np.float32))
    return Model(families, duels, np.stack(tables, axis=1) if tables else np.zeros((1 << BITS, 0), np.float32))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Model from the rows given (the caller leaves out what it holds out); null ids, texts or languages teach nothing."""
    src = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    known = src.where("d_id IS NOT NULL AND lang IS NOT NULL").where(F.octet_length("text") <= TRAIN_BYTES)  # before the draw: long texts take no one's place
    langs = [r[0] for r in known.select("lang").distinct().collect()]
    picked = bounded_sample(known, "lang", {v: max(1, SAMPLE // len(langs)) for v in langs}, "d_id", seed=9)
    rows = picked.toArrow().sort_by([("d_id", "ascending"), ("text", "ascending")])
    return fit_texts(rows["text"].to_pylist(), rows["lang"].to_pylist())


def _pick(names: list[str], margins: np.ndarray, duels: list[tuple[int, Duel]]) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-one votes among ``names`` (ties: larger sum of margins, then first name); confidence of the winner."""
    n = len(margins)
    votes, sums, sure = np.zeros((n, len(names))), np.zeros((n, len(names))), np.ones((n, len(names)))
    for k, d in duels:
        a, b, m = names.index(d.first), names.index(d.second), margins[:, k] * d.sharpness
        p = 1 / (1 + np.exp(-np.clip(m, -30, 30)))
        votes[:, a] += m >= 0
        votes[:, b] += m < 0
        sums[:, a] += m
        sums[:, b] -= m
        sure[:, a] = np.minimum(sure[:, a], p)
        sure[:, b] = np.minimum(sure[:, b], 1 - p)
    best = np.argmax(votes + sums / (1 + 4 * np.abs(sums).max(initial=1.0)), axis=1)
    return best, sure[np.arange(n), best]


def predict_batch(column: pa.Array, model: Model) -> tuple[list[str], np.ndarray]:
    langs: list[str] = []
    scores = []
    numbered = list(enumerate(model.duels))
    families = sorted(model.families)
    for at, n, raw, off in text_slices(column):
        buf, start = padded(raw, off, GRAM)
        codes = ngram_codes(np.frombuffer(buf.translate(LETTERS), np.uint8), GRAM, BITS)
        cut = start - 1
        size = np.diff(np.append(cut, len(codes)))
        margins = np.empty((n, len(numbered)))
        for k, d in numbered:
            margins[:, k] = np.add.reduceat(model.tables[:, k][codes].astype(np.float64), cut) / size + d.bias
        letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[raw])))
        known = letters[off[1:]] > letters[off[:-1]]
        for i in np.flatnonzero(~known & (np.diff(off) > 0)).tolist():
            known[i] = any(c.isalpha() for c in raw[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace"))
        known &= bool(families)
        out, score = np.full(n, UNKNOWN, dtype=object), np.zeros(n)
        if families:
            fam, sure = _pick(families, margins, [(k, d) for k, d in numbered if d.level == FAMILY_LEVEL])
            for f, name in enumerate(families):
                rows = np.flatnonzero(known & (fam == f))
                own = model.families[name]
                best, inner = _pick(own, margins[rows], [(k, d) for k, d in numbered if d.level == name])
                out[rows] = np.array(own, dtype=object)[best]
                score[rows] = sure[rows] * inner
        langs += out.tolist()
        scores.append(score)
    return langs, np.concatenate(scores) if scores else np.zeros(0)


def _predict(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = predict_batch(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(np.round(score, 6))], names=names)
    return run


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score 0..1) of every row; ``und`` with score 0 for a text that is null or has no letter.

    Ids may be null or repeated, texts empty or very long; other columns (any names) are not read.
    """
    src = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"))
    out = T.StructType([src.schema["c0"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return src.mapInArrow(_predict(model, out.names), out).withColumnRenamed("c0", id_col)
