"""Benchmark decontamination: CGK embedding and bit-sampling LSH over item-sized windows, then exact edit distances.

Texts are sequences of words (lower-cased letters and digits; everything else separates). A document is contaminated by an
item of n words if some run of its words is within n // 5 word edits of the item (similarity 0.8 and more).

Candidates: a CGK random walk reads a window word by word and, from one shared random bit per (step, word), advances or repeats;
two sequences at a small edit distance get embeddings at a small Hamming distance. Each of WALKS walks is sampled SAMPLES times at
BITS of its 2n steps, and windows that agree with an item in all sampled steps of one sample become candidates.
Embeddings drift apart with every further edit, so an item of more than PIECE words is embedded in pieces of PIECE words that overlap by half:
of the pieces of a run within the bound at least one has its share of the edits at most, so the walks meet no more edits in a long
item than in a short one. Any piece that agrees makes the window a candidate for the whole item.
WALKS * SAMPLES repetitions give a recall above 0.99 at the largest number of edits (tested from 5 to 400 words, for
insertions, substitutions and deletions apart, spread and in one place).
Windows are embedded where a word run of the item occurs in a text that holds as many of its runs as any text within the edit bound
must (q-gram lemma), aligned by that run. Every candidate is verified by the exact edit distance against the words around the window.

The items form broadcast blocks of at most BLOCK_BYTES of text; a larger benchmark takes one pass a block. Documents are
read once a block, whole, and never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import LETTERS, sequence_hash, span_hashes, text_slices, word_spans

WALKS, SAMPLES, BITS = 16, 4, 2
PIECE = 40  # words that are embedded at once
CELLS = 1 << 22  # words around windows that are compared at once
BLOCK_BYTES = 4_000_000
_LUT = np.frombuffer(LETTERS, np.uint8)
_GAP = _LUT == 32
_FILTER_BITS = 22


def edit_bound(n: int) -> int:
    return n // 5


def gram_size(n: int) -> int:
    """Longest word run, 3 at most, of which some occurrence survives edit_bound(n) edits."""
    e = edit_bound(n)
    return max(1, min(3, -(-(n - e) // (e + 1))))


def shared_grams(n, g: int):
    """Occurrences of grams of g words that survive edit_bound(n) edits of n words, at least (q-gram lemma)."""
    return np.maximum(1, n - g + 1 - g * (n // 5))


def word_ids(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, word hashes, first word of each text + total) of each slice."""
    for at, n, raw, off in text_slices(column):
        start, end, first = word_spans(raw, off, _GAP)
        yield at, n, span_hashes(raw, start, end, _LUT), first


@lru_cache(maxsize=256)
def _walk_plan(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random multipliers (walks x steps) and sampled steps (walks x samples x bits) for items of n words."""
    rng = np.random.default_rng((8, n))
    odd = rng.integers(0, 1 << 63, (WALKS, 2 * n), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, np.sort(np.argsort(rng.random((WALKS, SAMPLES, 2 * n)), axis=2)[:, :, :BITS], axis=2)


def walk_keys(words: np.ndarray, start: np.ndarray, stop: np.ndarray, n: int) -> np.ndarray:
    """LSH keys (windows x repetitions) of the n-word windows at ``start``; words at or after ``stop`` read as 0."""
    odd, picks = _walk_plan(n)
    wanted = {int(j): k for k, j in enumerate(np.unique(picks))}
    seen = np.empty((len(wanted), WALKS, len(start)), dtype=np.uint64)
    at, stop = np.broadcast_to(start, (WALKS, len(start))).copy(), np.minimum(stop, start + n)
    for j in range(max(wanted) + 1):
        word = np.where(at < stop, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        if j in wanted:
            seen[wanted[j]] = word
        at += ((word * odd[:, j, None]) >> np.uint64(63)).astype(np.int64)
    out = np.empty((len(start), WALKS * SAMPLES), dtype=np.uint64)
    for w in range(WALKS):
        for s in range(SAMPLES):
            r = w * SAMPLES + s
            out[:, r] = sequence_hash([seen[wanted[int(j)], w] for j in picks[w, s]], salt=r + 1)
    return out


def window_edits(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Row by row, the fewest word edits between the item and any run of the text (word 0 equals nothing)."""
    col = np.arange(texts.shape[1] + 1)
    row = np.zeros((len(texts), texts.shape[1] + 1), dtype=np.int64)
    for k in range(items.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = k + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (texts != items[:, k, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - col, axis=1) + col
    return row.min(axis=1)


def piece_offsets(n: int) -> list[int]:
    """First words of an item's pieces: overlapping by half, the last one ends with the item."""
    return [0] if n <= PIECE else [*range(0, n - PIECE, PIECE // 2), n - PIECE]


class ItemIndex:
    """One block of benchmark items with their n-gram postings and LSH tables (built on first use in a task)."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        self.ids, self.texts = ids, texts

    def __getstate__(self):
        return {"ids": self.ids, "texts": self.texts}

    def __setstate__(self, state):
        self.__dict__.update(state)

    @cached_property
    def words(self) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for _, n, h, first in word_ids(pa.array(self.texts, pa.large_string())):
            out += [h[first[i] : first[i + 1]] for i in range(n)]
        return out

    @cached_property
    def grams(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Gram size -> sorted hashes, their item and offset, and a bit filter over them."""
        rows: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if len(w):
                g = gram_size(len(w))
                h = sequence_hash([w[k : len(w) - g + 1 + k] for k in range(g)])
                rows.setdefault(g, []).append((h, np.full(len(h), i), np.arange(len(h))))
        out = {}
        for g, parts in rows.items():
            h, item, at = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
            out[g] = h[order], item[order], at[order], bits
        return out

    @cached_property
    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item and first word of each piece, and the first piece of each item (+ total)."""
        offsets = [piece_offsets(len(w)) if len(w) else [] for w in self.words]
        first = np.concatenate(([0], np.cumsum([len(o) for o in offsets]))).astype(np.int64)
        return np.repeat(np.arange(len(offsets)), np.diff(first)), np.array([k for o in offsets for k in o], np.int64), first

    @cached_property
    def tables(self) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """Piece length (PIECE at most) -> for each repetition the sorted keys and their pieces."""
        item, offset, _ = self.pieces
        size, out = np.minimum(self.lengths[item], PIECE), {}
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            words = np.concatenate([self.words[item[p]][offset[p] : offset[p] + n] for p in mine])
            start = np.arange(len(mine)) * n
            keys = walk_keys(words, start, start + n, n)
            out[n] = [(keys[order, r], mine[order]) for r in range(keys.shape[1]) for order in [np.argsort(keys[:, r], kind="stable")]]
        return out

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(w) for w in self.words], dtype=np.int64)

    def _seeds(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, window start, place in the item) of the shared grams, where a document shares enough of them."""
        docs, items, starts, places = [], [], [], []
        for g, (h, item, offset, bits) in self.grams.items():
            if len(words) < g:
                continue
            mine = sequence_hash([words[k : len(words) - g + 1 + k] for k in range(g)])
            pos = np.flatnonzero(bits[(mine >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(h, mine[pos], "left"), np.searchsorted(h, mine[pos], "right")
            pos, lo, n = pos[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(pos):
                continue
            doc = np.searchsorted(first, pos, side="right") - 1
            inside = pos + g <= first[doc + 1]
            pos, lo, n, doc = pos[inside], lo[inside], n[inside], doc[inside]
            if not len(pos):
                continue
            posting = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pos, doc, it = np.repeat(pos, n), np.repeat(doc, n), item[posting]
            size = self.lengths[it]
            need = shared_grams(size, g)  # for the grams of a whole document
            pair, inverse, count = np.unique(doc * len(self.lengths) + it, return_inverse=True, return_counts=True)
            keep = count[inverse] >= need
            docs.append(doc[keep])
            items.append(it[keep])
            starts.append(pos[keep] - offset[posting][keep])
            places.append(offset[posting][keep])
        if not docs:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in (docs, items, starts, places))

    def _collisions(self, words: np.ndarray, first: np.ndarray, doc: np.ndarray, item: np.ndarray, start: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        """Document, item and start of the windows that agree with a piece of an item of n words in a repetition."""
        _, offset, of = self.pieces
        size, found = min(n, PIECE), []
        cuts = np.array(piece_offsets(n))
        for k in range(len(cuts)):  # the pieces that the gram lies in
            on = (place >= cuts[k]) & (place < cuts[k] + size)
            rows = np.unique(np.stack((doc[on], start[on])), axis=1)
            if not rows.size:
                continue
            at = np.maximum(rows[1] + cuts[k], first[rows[0]])
            keys = walk_keys(words, at, first[rows[0] + 1], size)
            for r, (known, pieces) in enumerate(self.tables[size]):
                lo, hi = np.searchsorted(known, keys[:, r], "left"), np.searchsorted(known, keys[:, r], "right")
                hit = np.flatnonzero(hi > lo)
                count = (hi - lo)[hit]
                piece = pieces[np.repeat(lo[hit] - (np.cumsum(count) - count), count) + np.arange(count.sum())]
                w = np.repeat(hit, count)
                owner = np.searchsorted(of, piece, side="right") - 1
                right = (self.lengths[owner] == n) & (offset[piece] == cuts[k])
                found.append(np.stack((rows[0, w], owner, np.maximum(rows[1, w], first[rows[0, w]])))[:, right])
            found = [np.unique(np.concatenate(found, axis=1), axis=1)] if found else []
        return found[0] if found else np.zeros((3, 0), np.int64)

    def matches(self, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(document, item, first word of the window, edits) of every verified pair, one row a pair (fewest edits, first window)."""
        doc, item, start, place = self._seeds(words, first)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        if not len(doc):
            return []
        for n in np.unique(self.lengths[item]).tolist():
            rows, e = np.flatnonzero(self.lengths[item] == n), edit_bound(n)
            d_, i_, s_ = self._collisions(words, first, doc[rows], item[rows], start[rows], place[rows], n)
            step = max(1, min(4096, CELLS // (n + 2 * e)))
            for at in range(0, len(d_), step):
                d, i, s = (x[at : at + step] for x in (d_, i_, s_))
                spot = (s - e)[:, None] + np.arange(n + 2 * e)
                inside = (spot >= first[d][:, None]) & (spot < first[d + 1][:, None])
                around = np.where(inside, words[np.clip(spot, 0, len(words) - 1)], np.uint64(0))
                edits = window_edits(np.stack([self.words[k] for k in i]), around)
                for k in np.flatnonzero(edits <= e).tolist():
                    pair, hit = (int(d[k]), int(i[k])), (int(edits[k]), int(s[k] - first[d[k]]))
                    best[pair] = min(best.get(pair, hit), hit)
        return [(d, i, s, e) for (d, i), (e, s) in sorted(best.items())]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[ItemIndex]:
    """The benchmark in blocks of about BLOCK_BYTES of text each. Items without a word match nothing and are left out."""
    src = items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    out = []
    for b in range(blocks):
        rows = src.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).toArrow().sort_by([("id", "ascending"), ("text", "ascending")])
        out.append(ItemIndex(rows["id"].to_pylist(), rows["text"].to_pylist()))
    return out


def _find(index: ItemIndex, names: list[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at + d, i, s, e) for at, n, words, first in word_ids(batch.column(1)) for d, i, s, e in index.matches(words, first)]
            doc = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(doc).cast(kind), pa.array([index.ids[r[1]] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int32())], names=names)
    return run


def contaminations(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, edits): one row for each document row and benchmark item it holds.

    ``start_word`` counts from 0 in the document's words. Null and empty texts and items match nothing; rows that
    repeat are reported each; ids may be null; other columns (any names) are not read. An empty benchmark gives no rows.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()),
                        T.StructField("start_word", T.LongType()), T.StructField("edits", T.IntegerType())])
    found = None
    for index in item_blocks(items):
        part = src.mapInArrow(_find(index, out.names, pa.int64()), out)
        found = part if found is None else found.unionByName(part)
    return found.withColumnRenamed("doc_id", id_col)


def _drop(index: ItemIndex, text_at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, dtype=bool)
            for at, n, words, first in word_ids(batch.column(text_at)):
                for d, *_ in index.matches(words, first):
                    keep[at + d] = False
            yield batch.filter(pa.array(keep))
    return run


def keep_uncontaminated(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item."""
    for index in item_blocks(items):
        docs = docs.mapInArrow(_drop(index, docs.columns.index(text_col)), docs.schema)
    return docs
