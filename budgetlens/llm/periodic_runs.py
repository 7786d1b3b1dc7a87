"""Periodic runs of words: Baier's suffix grouping gives the Lyndon arrays of both orders, whose roots extend into runs.

A run is a stretch of words that repeats its first ``period`` words and that no neighbouring word extends. Every run holds, under
one of the two opposite orders of the words, a Lyndon word of its period's length (a root) that is the longest one at its place.
  1. cut      : a run of exponent e holds each of its words floor(e) times at least, so rarer words cut a text into segments, again
                and again; what is left of plain prose is next to nothing, and no run crosses a cut;
  2. grouping : phase one of Baier's suffix sorter over all segments of a slice. Positions start in one group a word; groups are
                taken in descending order, and the nearest position to the left that lies in a lower group appends the group's
                context to its own. In the end a position's context is the longest Lyndon word there, and positions share a
                group if and only if they share that word. Run once for each order of the words;
  3. roots    : positions one root apart in the same group form chains; a chain's head is a root, its links are whole periods;
  4. extension: the common extensions (LCE) of a chain to both sides, each shorter than the period, give the run.

Nothing is shuffled: a text meets no other. Words are compared by 64-bit hashes within their slice. Memory is bounded by
SLICE_BYTES of text or one text; the grouping takes some 40 bytes a word that the cuts leave.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import mix64, span_hashes, text_slices, word_spans

SLICE_BYTES = 1 << 19
ROUNDS = 8  # of cuts; they only save work


def lyndon_groups(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group and length of the longest Lyndon word at each position; code 0 (at the first position too) separates strings.

    Phase one of Baier's sorter. The groups lie in one array in their order, as ranges: what leaves a group upwards takes the
    end of its range. Taking the ranges from the right is taking the groups in descending order.
    """
    n = len(code)
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    sa, place, group = array("i"), array("i"), array("i")
    sa.frombytes(order.astype(np.int32).tobytes())
    back = np.empty(n, np.int32)
    back[order] = np.arange(n, dtype=np.int32)
    place.frombytes(back.tobytes())
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, n)))
    group.frombytes(rank.tobytes())
    start, size = array("i", first.tolist()), array("i", np.diff(np.append(first, n)).tolist())
    context = array("q", [1] * len(first))
    left = array("i", range(-1, n - 1))  # of a taken position: one nearer to the next that is not taken
    taken = bytearray(n)
    lowest = int((code == 0).sum())  # separators are never taken
    at = n - 1
    while at >= lowest:
        g = group[sa[at]]
        begin, word = start[g], context[g]
        members = sa[begin : at + 1]
        at = begin - 1
        for i in members:
            taken[i] = 1
        count: dict[int, int] = {}
        for i in members:
            p = i - 1
            while taken[p]:
                q = left[p]
                if taken[q]:
                    left[p] = left[q]
                p = q
            left[i] = p
            count[p] = count.get(p, 0) + 1
        found = count.items() if len(count) == len(members) else sorted(count.items(), key=lambda x: -x[1])
        made: dict[int, int] = {}
        before = 0
        for p, times in found:  # the more often, the higher: the first takes the end of its range
            if times != before:
                made, before = {}, times
            if place[p] < lowest:
                continue
            q = group[p]
            if size[q] == 1 and q not in made:  # alone in its group: the group's own context grows
                context[q] += times * word
                continue
            end = start[q] + size[q] - 1
            other, spot = sa[end], place[p]
            sa[spot], place[other] = other, spot
            sa[end], place[p] = p, end
            size[q] -= 1
            new = made.get(q)
            if new is None:
                new = made[q] = len(start)
                start.append(end)
                size.append(0)
                context.append(context[q] + times * word)
            start[new] = end
            size[new] += 1
            group[p] = new
    groups = np.frombuffer(group, np.int32)
    return groups, np.frombuffer(context, np.int64)[groups]


def _chains(code: np.ndarray, links: int) -> Iterator[tuple[int, int, int]]:
    """(head, period, roots) of each chain of at least ``links`` + 1 equal roots one after the other."""
    group, size = lyndon_groups(code)
    n = len(code)
    at = np.arange(n)
    after = np.minimum(at + size, n - 1)
    same = (at + size < n) & (group[after] == group) & (code != 0)
    head = same.copy()
    head[after[same]] = False
    for i in np.flatnonzero(head).tolist():
        p, k, j = int(size[i]), 1, i
        while same[j]:
            j += p
            k += 1
        if k > links:
            yield i, p, k


def find_runs(code: np.ndarray, min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """Sorted (start, length, period) of the runs of ``code`` (0 separates; there is one at the start).

    ``min_exponent`` is at least 3, so a run holds two roots that follow each other, whole: both extensions are shorter than one.
    """
    n, found = len(code), set()
    links = math.floor(min_exponent) - 2  # extensions add less than two periods to the roots
    for order in (code, np.where(code == 0, 0, code.max(initial=0) + 1 - code)):
        for i, p, k in _chains(order, links):
            end = i + k * p
            to = min(n, end + p)
            differ = np.flatnonzero(code[end:to] != code[end - p : to - p])
            right = end + (int(differ[0]) if len(differ) else to - end)
            low = max(0, i - p)
            differ = np.flatnonzero(code[low:i] != code[low + p : i + p])
            left = low + (int(differ[-1]) + 1 if len(differ) else 0)
            if right - left >= max(min_length, min_exponent * p):
                found.add((left, right - left, p))
    return sorted(found)


def segments(words: np.ndarray, first: np.ndarray, min_length: int, min_exponent: float) -> np.ndarray:
    """Positions of the words that can lie in a run: texts cut at words too rare for one, ROUNDS times at most."""
    segment = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(words))
    for _ in range(ROUNDS if len(at) else 0):
        _, inverse, count = np.unique(mix64(words[at] + segment.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_inverse=True, return_counts=True)
        keep = count[inverse] >= math.floor(min_exponent)
        at, of = at[keep], segment[keep]
        border = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(of) != 0))) if len(at) else np.zeros(0, bool)
        piece = np.cumsum(border) - 1
        long = (np.bincount(piece) >= min_length)[piece] if len(at) else border
        done = keep.all() and long.all()
        at, segment = at[long], piece[long]
        if done:
            break
    return at


def slice_runs(words: np.ndarray, first: np.ndarray, min_length: int, min_exponent: float) -> list[tuple[int, int, int]]:
    """Runs of all texts of a slice, as (first word within the slice, length, period)."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = segments(words, first, min_length, min_exponent)
    if not len(at):
        return []
    border = np.concatenate(([True], (np.diff(at) != 1) | (np.diff(text[at]) != 0)))
    spot = np.arange(len(at)) + np.cumsum(border)
    code = np.zeros(spot[-1] + 1, np.int64)
    code[spot] = np.unique(words[at], return_inverse=True)[1] + 1
    word = np.zeros(len(code), np.int64)
    word[spot] = at
    return [(int(word[s]), size, p) for s, size, p in find_runs(code, min_length, min_exponent)]


_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_ARROW_RUN = pa.struct([(x, pa.int64()) for x in ("start", "length", "period")])


def _runs(min_length: int, min_exponent: float, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n, raw, off in text_slices(batch.column(1), SLICE_BYTES):
                start, end, first = word_spans(raw, off)
                found: list[list] = [[] for _ in range(n)]
                drop = np.zeros(len(start) + 1, np.int64)
                for s, size, p in slice_runs(span_hashes(raw, start, end), first, min_length, min_exponent):
                    d = int(np.searchsorted(first, s, side="right")) - 1
                    found[d].append({"start": s - int(first[d]), "length": size, "period": p})
                    drop[s + p] += 1
                    drop[s + size] -= 1
                gone, text, cuts = np.cumsum(drop)[:-1] > 0, raw.tobytes(), off.tolist()
                kept = []
                for d in range(n):
                    words = text[cuts[d] : cuts[d + 1]].split()
                    if found[d]:
                        words = [w for w, g in zip(words, gone[first[d] : first[d + 1]].tolist(), strict=True) if not g]
                    kept.append(b" ".join(words))
                cols = [batch.column(0).slice(at, n), pa.array(np.diff(first)), pa.array(found, pa.list_(_ARROW_RUN)), pa.array(kept, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: float = 4.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` lists (start, length, period) by start, then period: the maximal stretches of words whose smallest period is
    ``period`` and that are at least ``min_length`` words and ``min_exponent`` (3 or more) periods long. ``collapsed`` joins by one space the words
    that no run holds behind its first period. Words are runs of bytes other than ASCII white space, unchanged. Null and
    empty texts have no words and no runs. Each row is judged alone, so ids may be null or repeated; other columns (any
    names) are not read.
    """
    if min_exponent < 3:
        raise ValueError("runs of fewer than three periods are not searched")
    src = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"))
    out = T.StructType([src.schema["c0"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])
    return src.mapInArrow(_runs(min_length, min_exponent, out.names), out).withColumnRenamed("c0", id_col)


def _loop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for h, text in zip(batch.column(2).to_pylist(), batch.column(1), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            n, g = len(words), h // 10
            if n:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]
            texts.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])


def with_loops(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which one text of ten, by the CRC-32 of its id, repeats a stretch of its words up to its end.

    With h that CRC and g = h div 10, texts with h mod 10 = 0 repeat the p words from word a on; a = g mod n and
    p = 1 + (n - a) div (3 + g mod 8) for n words, which are then joined by one space. Texts that are null or without words stay
    without words, as do rows without id unchanged. Only the chosen rows go through Python.
    """
    src = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    chosen = F.coalesce(F.col("h") % 10 == 0, F.lit(False))
    looped = src.where(chosen).mapInArrow(_loop, T.StructType([src.schema["doc_id"], T.StructField("text", T.StringType())]))
    return src.where(~chosen).select("doc_id", "text").unionByName(looped)
