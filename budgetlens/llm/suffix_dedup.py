"""Suffix-array dedup by prefix-free parsing: phrases between rolling-hash triggers, ordered by their dictionary and parse.

Texts are byte strings. A byte goes if a ``window`` of bytes that covers it also starts earlier (in a smaller row, or in the same
one further left). A trigger is a place whose rolling hash (GRAM bytes) is the smallest among ``reach`` neighbours, so every window
holds one in its first ``reach`` places, the same in all copies of the window. The window starts that share a trigger are a block
[lo, hi]; the bytes that its windows touch are an extended phrase. Equal windows start in blocks whose triggers begin with
the same ``window - reach + 1`` bytes (the block's key), and equal phrases share all their windows. One record a phrase moves, not
one a byte; of repetitive text, one record a distinct phrase and task:
  1. parse      : tasks cut their texts into phrases and send the first of each distinct one to the part of its key; other copies
                  are marked as repeats at once;
  2. dictionary : a part marks the copies that a phrase has in other tasks. Only phrases that share their key with another
                  distinct one are open: some of their windows may repeat;
  3. extraction : the texts of open phrases go to the part of their key;
  4. order      : a phrase's part before its trigger is a suffix of the dictionary (sorted from the trigger backwards), the bytes from the
                  trigger on are the parse's suffix. Both are sorted, with their common prefixes; a window that starts a places
                  before its trigger has the rank pair of both at depths a and window - a. Windows of one pair lie together in the corpus
                  order, and all but their first are marked;
  5. removal    : a text drops the bytes that marked windows cover.
A key that many distinct phrases share (the edges of a passage that a third of all texts hold) would gather in one part: when ``local``
of them meet in one flush, or ``hot`` in a part, their windows are dealt one by one by their own hash, one of each in a flush.

Phrases and hot windows are compared by 128-bit hashes, windows of open phrases byte by byte. A task holds a flush, a part's
share of the records (parts grow with the input) or one text. What shares a flush decides which copies are marked at once; flushes follow the
order of the files in 1 and of the rows' keys in 3, so a task that runs again sends the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import by_part, groups, pack, shuffle_partitions, span_hashes, stored, text_slices, unpack

GRAM = 8  # bytes of the rolling hash
PIECE = 1 << 19  # bytes parsed at once
FLUSH_BYTES = 16 << 20
PART_BYTES = (8 << 20, 256 << 20)  # of text a part: no less (or messages get tiny) and no more
MEMBERS = 1 << 16  # open phrases ordered at once
#: Bytes parsed and flushed at once, phrases ordered at once, and the distinct phrases of a key beyond which it is hot: in a flush, in a part.
LIMITS = {"piece": PIECE, "flush": FLUSH_BYTES, "members": MEMBERS, "local": 32, "hot": 4096}
_BASE = 0x9E3779B97F4A7C55 | 1
_SECOND = 0xC2B2AE3D27D4EB4F | 1
_RECORDS, _HOT_KEYS, _MARKS, _ASKS, _OPEN, _WINDOWS, _TEXTS = range(7)  # kinds; a part's marks come before its texts
_WHOLE, _ASKED, _BY_WINDOW = range(3)  # codes of marks: repeats; open; open and hot

_WIRE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("blob", T.BinaryType())])
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("blob", pa.binary())])
_RESULT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])
_ARROW_RESULT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r, strict=True)) for r in rows], schema=_ARROW)


def _joined(held: list[tuple]) -> list[np.ndarray]:
    return [np.concatenate(x) for x in zip(*held, strict=True)]


# --------------------------------------------------------------------------- 1 parse
def anchors(raw: np.ndarray, reach: int) -> np.ndarray:
    """For each position x, the place of the smallest rolling hash (the leftmost one) in [x, x + reach)."""
    n = len(raw)
    gram = np.ndarray(shape=(n,), dtype="<u8", buffer=np.concatenate((raw, np.zeros(GRAM, np.uint8))), strides=(1,))
    low = (gram * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000) | np.arange(n, dtype=np.uint64)
    size = 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: len(low) - (reach - size)], low[reach - size :])
    return (low & np.uint64(0xFFFFFFFF)).astype(np.int64)


def blocks(raw: np.ndarray, valid: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window start, and trigger, of each block; ``valid`` marks the starts whose window ends in its text."""
    x = np.flatnonzero(valid)
    if not len(x):
        return x, x, x
    trigger = anchors(raw, reach)[x]
    new = np.concatenate(([True], (np.diff(trigger) != 0) | (np.diff(x) != 1)))
    return x[new], x[np.concatenate((new[1:], [True]))], trigger[new]


def _starts(offsets: np.ndarray, window: int) -> np.ndarray:
    """Positions of a slice at which a whole window starts in its text."""
    edge = np.zeros(int(offsets[-1]) + 1, np.int8)
    long = np.diff(offsets) >= window
    edge[offsets[:-1][long]] += 1
    np.add.at(edge, offsets[1:][long] - window + 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def _marks(key: np.ndarray, part: np.ndarray, lo: np.ndarray, size: np.ndarray, lead: np.ndarray, code: np.ndarray) -> Iterator[tuple]:
    """Rows of marks, by the part of their text: window starts lo..lo+size-1, whose trigger lies ``lead`` behind lo."""
    for p, r in groups(part.astype(np.int64) * 2 + (code != _WHOLE)):
        r = r[np.lexsort((lo[r], key[r]))]
        yield p // 2, _ASKS if p % 2 else _MARKS, 0, pack(key[r], lo[r], size[r], lead[r], code[r])


def _flush(held: list[tuple], parts: int, local: int) -> pa.RecordBatch:
    """Records of the first of each distinct phrase; marks of its copies, and of the phrases of keys that are hot here."""
    h, e, ident, key, part, lo, size, lead = _joined(held)
    order = _sorted(h, e, ident, key, lo)
    h, e, ident, key, part, lo, size, lead = (x[order] for x in (h, e, ident, key, part, lo, size, lead))
    first, again = _firsts(h, e, ident, key, lo)
    at = np.flatnonzero(first)
    keys, inverse, count = np.unique(h[at], return_inverse=True, return_counts=True)
    hot = count[inverse] > local
    code = np.zeros(len(h), np.uint8)
    code[at[hot]] = _BY_WINDOW
    marked = again.copy()
    marked[at[hot]] = True
    out = list(_marks(*(x[marked] for x in (key, part, lo, size, lead, code))))
    sent = at[~hot]
    for p, r in groups((h[sent] % np.uint64(parts)).astype(np.int64)):
        r = sent[r]
        out.append((p, _RECORDS, 0, pack(*(x[r] for x in (h, e, ident, key, part, lo, size, lead)))))
    busy = keys[count > local]
    for p, r in groups((busy % np.uint64(parts)).astype(np.int64)):
        out.append((p, _HOT_KEYS, 0, pack(busy[r])))
    return _rows(out)


def _sorted(h: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """Order by h, then by the other columns, which only equal values of h need."""
    order = np.argsort(h, kind="stable")
    same = np.diff(h[order]) == 0
    tied = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same)))
    some = order[tied]
    order[tied] = some[np.lexsort((*(x[some] for x in reversed(rest)), h[some]))]
    return order


def _firsts(h: np.ndarray, e: np.ndarray, ident: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted records: the first of each phrase, and its other copies (a repeated row's own are neither)."""
    first = np.concatenate(([True], (np.diff(h) != 0) | (np.diff(e) != 0)))
    head = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
    same = (ident == ident[head]) & (key == key[head]) & (lo == lo[head])
    return first, ~first & ~same


def _parse(window: int, reach: int, parts: int, local: int, flush_bytes: int, piece_bytes: int):
    size = window - reach + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            keys, dest, ident = (batch.column(k).to_numpy() for k in (0, 1, 3))
            for at, _, raw, off in text_slices(batch.column(2), piece_bytes):
                valid = _starts(off, window)
                for c in range(0, len(raw), piece_bytes):  # a long text; a block cut here stays right, being another phrase
                    piece, here = raw[c : c + piece_bytes + window], valid[c : c + piece_bytes]
                    lo, hi, trigger = blocks(piece, here, reach)
                    if not len(lo):
                        continue
                    doc = np.searchsorted(off, c + lo, side="right") - 1
                    held.append((
                        span_hashes(piece, trigger, trigger + size), span_hashes(piece, lo, hi + window, base=_SECOND), ident[at + doc], keys[at + doc], dest[at + doc],
                        (c + lo - off[doc]).astype(np.int32), (hi - lo + 1).astype(np.uint16), (trigger - lo).astype(np.uint16)))
                weight += len(raw)
                if weight >= flush_bytes:
                    if held:
                        yield _flush(held, parts, local)
                    held, weight = [], 0
        if held:
            yield _flush(held, parts, local)
    return run


# --------------------------------------------------------------------------- 2 dictionary
def _settle(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Marks of the phrases that came before, and of those whose key has other phrases; other rows pass."""
        for _, rows in by_part(batches):
            held, hot, other = [], [], []
            for row in rows:
                if row["kind"] == _RECORDS:
                    held.append(unpack(row["blob"]))
                elif row["kind"] == _HOT_KEYS:
                    hot += unpack(row["blob"])
                else:
                    other.append(tuple(row[x] for x in _ARROW.names))
                    if len(other) >= 64:
                        yield _rows(other)
                        other = []
            if held:
                h, e, ident, key, part, lo, size, lead = _joined(held)
                del held
                order = _sorted(h, e, ident, key, lo)
                h, e, ident, key, part, lo, size, lead = (x[order] for x in (h, e, ident, key, part, lo, size, lead))
                first, again = _firsts(h, e, ident, key, lo)
                at = np.flatnonzero(first)
                _, inverse, count = np.unique(h[at], return_inverse=True, return_counts=True)
                busy = count[inverse] > most
                if hot:
                    busy |= np.isin(h[at], np.concatenate(hot))
                code = np.zeros(len(h), np.uint8)
                code[at] = np.where(busy, _BY_WINDOW, np.where(count[inverse] > 1, _ASKED, _WHOLE))
                marked = again | (code > 0)
                other += _marks(*(x[marked] for x in (key, part, lo, size, lead, code)))
            if other:
                yield _rows(other)
    return run


# --------------------------------------------------------------------------- texts and their marks
def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of a slice that go to one part, as one blob."""
    for batch in batches:
        keys, dest, ident, null = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 3, 4))
        out = []
        for at, n, raw, off in text_slices(batch.column(2), FLUSH_BYTES):
            for p, r in groups(dest[at : at + n]):
                body = np.concatenate([raw[off[k] : off[k + 1]] for k in r.tolist()])
                out.append((p, _TEXTS, int(keys[at + r[0]]), pack(keys[at + r], ident[at + r], null[at + r], off[r + 1] - off[r], body)))
            yield _rows(out)
            out = []


class _Marked:
    """A part's marks, by text."""

    def __init__(self):
        self.chunks, self.ready = [], None

    def add(self, blob: bytes) -> None:
        self.chunks.append(unpack(blob))

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(text among ``keys``, columns of the marks) of all marks of these texts."""
        if self.ready is None:
            self.ready = _joined(self.chunks) if self.chunks else [np.zeros(0, np.int64) for _ in range(5)]
            self.chunks = []
            order = np.argsort(self.ready[0], kind="stable")
            self.ready = [x[order] for x in self.ready]
        a, b = (np.searchsorted(self.ready[0], keys, side) for side in ("left", "right"))
        count = b - a
        at = np.repeat(a - (np.cumsum(count) - count), count) + np.arange(count.sum())
        return np.repeat(np.arange(len(keys)), count), [x[at] for x in self.ready]


# --------------------------------------------------------------------------- 3 extraction
def _extract(window: int, reach: int, parts: int, flush_bytes: int):
    key_bytes = window - reach + 1

    def open_rows(raw, off, ident, keys, part, doc, lo, size, lead) -> Iterator[tuple]:
        start = off[doc] + lo
        to = start + size + window - 1
        target = (span_hashes(raw, start + lead, start + lead + key_bytes) % np.uint64(parts)).astype(np.int64)
        for p, r in groups(target):
            body = np.concatenate([raw[a:b] for a, b in zip(start[r].tolist(), to[r].tolist(), strict=True)])
            yield p, _OPEN, 0, pack(body, ident[doc[r]], keys[doc[r]], np.full(len(r), part, np.int32), lo[r], size[r], lead[r])

    def windows(raw, off, ident, keys, part, doc, lo, size) -> tuple:
        count = size.astype(np.int64)
        of = np.repeat(np.arange(len(doc)), count)
        x = lo[of].astype(np.int64) + np.arange(len(of)) - (np.cumsum(count) - count)[of]
        at = off[doc[of]] + x
        return (*(np.concatenate([span_hashes(raw, at[k : k + PIECE], at[k : k + PIECE] + window, base=b) for k in range(0, len(at), PIECE)]) for b in (_BASE, _SECOND)),
                ident[doc[of]], keys[doc[of]], np.full(len(of), part, np.int32), x.astype(np.int32))

    def dealt(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        h, e, ident, key, part, x = _joined(held)
        order = _sorted(h, e, ident, key, x)
        h, e, ident, key, part, x = (c[order] for c in (h, e, ident, key, part, x))
        first, again = _firsts(h, e, ident, key, x)
        out = list(_window_marks(*(c[again] for c in (key, part, x))))
        at = np.flatnonzero(first)
        for p, r in groups((h[at] % np.uint64(parts)).astype(np.int64)):
            out.append((p, _WINDOWS, 0, pack(*(c[at[r]] for c in (h, e, ident, key, part, x)))))
        yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            marked, held, weight = _Marked(), [], 0
            for row in rows:
                if row["kind"] == _ASKS:
                    marked.add(row["blob"])
                    continue
                keys, ident, _, size, raw = unpack(row["blob"])
                off = np.cumsum(size) - size
                doc, (_, lo, n, lead, code) = marked.of(keys)
                ask = code == _ASKED
                if ask.any():
                    yield _rows(list(open_rows(raw, off, ident, keys, part, doc[ask], lo[ask], n[ask], lead[ask])))
                hot = code == _BY_WINDOW
                if hot.any():
                    held.append(windows(raw, off, ident, keys, part, doc[hot], lo[hot], n[hot]))
                    weight += len(held[-1][0])
                    if weight >= flush_bytes // 16:
                        yield from dealt(held)
                        held, weight = [], 0
            if held:
                yield from dealt(held)
    return run


def _window_marks(key: np.ndarray, part: np.ndarray, x: np.ndarray) -> Iterator[tuple]:
    """Marks of single window starts, as runs."""
    if not len(x):
        return
    order = np.lexsort((x, key, part))
    key, part, x = key[order], part[order], x[order].astype(np.int64)
    new = np.concatenate(([True], (np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(x) > 1)))
    at = np.flatnonzero(new)
    to = np.append(at[1:], len(x)) - 1
    size = x[to] - x[at] + 1
    while (size > 65535).any():  # longer than the column holds: two marks
        long = np.flatnonzero(size > 65535)
        at, size = np.append(at, at[long]), np.append(size, size[long] - 65535)
        x, key, part = np.append(x, x[at[long]] + 65535), np.append(key, key[at[long]]), np.append(part, part[at[long]])
        at[-len(long) :] = np.arange(len(x) - len(long), len(x))
        size[long] = 65535
    zero = np.zeros(len(at), np.uint16)
    yield from _marks(key[at], part[at], x[at].astype(np.int32), size.astype(np.uint16), zero, zero.astype(np.uint8))


# --------------------------------------------------------------------------- 4 order
def _ranks(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each string among the distinct ones, and the common prefix of each distinct one with the one before."""
    distinct = sorted(set(strings))
    rank = {s: k for k, s in enumerate(distinct)}
    size = np.array([len(s) for s in distinct])
    width = int(size.max(initial=0)) + 1
    lcp = np.zeros(len(distinct), np.int64)
    for a in range(0, len(distinct), MEMBERS):
        some = distinct[max(0, a - 1) : a + MEMBERS]
        table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in some), np.uint8).reshape(len(some), width)
        same = table[1:] == table[:-1]
        first = np.where(same.all(axis=1), width, np.argmin(same, axis=1))
        lcp[max(1, a) : a + MEMBERS] = np.minimum(first, np.minimum(size[max(0, a - 1) : a + MEMBERS][1:], size[max(0, a - 1) : a + MEMBERS][:-1]))
    return np.array([rank[s] for s in strings], np.int64), lcp


def repeated_windows(phrases: list[bytes], size: np.ndarray, lead: np.ndarray, rank: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(phrase, places before its trigger) of every window that also starts in a phrase of smaller ``rank`` or further left.

    A phrase holds the windows that start at its first ``size`` bytes; its trigger lies ``lead`` bytes in. The sorted reversed
    heads are the dictionary's suffixes, the sorted tails those of the parse; both ranks, cut to the window, order the corpus.
    """
    head, head_lcp = _ranks([s[:a][::-1] for s, a in zip(phrases, lead.tolist(), strict=True)])
    tail, tail_lcp = _ranks([s[a:] for s, a in zip(phrases, lead.tolist(), strict=True)])
    last = lead.astype(np.int64)  # places before the trigger of the first window, and of the last
    low = last - size.astype(np.int64) + 1
    found = []
    for a in range(int(low.min(initial=0)), int(last.max(initial=-1)) + 1):
        here = np.flatnonzero((low <= a) & (a <= last))
        if len(here) < 2:
            continue
        order_of = np.cumsum(tail_lcp < window - a)[tail[here]] * (len(head_lcp) + 1) + np.cumsum(head_lcp < a)[head[here]]
        order = np.lexsort((rank[here], order_of))
        again = order[1:][order_of[order[1:]] == order_of[order[:-1]]]
        found.append((here[again], np.full(len(again), a)))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(_joined(found))


def _order(window: int, reach: int, members: int):
    key_bytes = window - reach + 1

    def ordered(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        body, ident, key, part, lo, size, lead = _joined(held)
        to = np.cumsum(size.astype(np.int64) + window - 1)
        begin = np.concatenate(([0], to[:-1]))
        h = np.concatenate([span_hashes(body[a:b], s - a, s - a + key_bytes) for a, b, s in _chunks(body, begin, to, begin + lead)])
        by_key = np.argsort(h, kind="stable")
        border = np.concatenate((np.flatnonzero(np.diff(h[by_key])) + 1, [len(h)]))
        at = 0
        while at < len(h):  # whole groups of one key, ``members`` phrases or one group at once
            end = int(border[max(np.searchsorted(border, at + members, side="right") - 1, np.searchsorted(border, at, side="right"))])
            r = by_key[at:end]
            at = end
            r = r[np.lexsort((lo[r], key[r], ident[r]))]
            r = r[np.concatenate(([True], (np.diff(ident[r]) != 0) | (np.diff(key[r]) != 0) | (np.diff(lo[r]) != 0)))]  # equal rows are one
            member, a = repeated_windows([body[x:y].tobytes() for x, y in zip(begin[r].tolist(), to[r].tolist(), strict=True)], size[r], lead[r], np.arange(len(r)), window)
            m = r[member]
            out = list(_window_marks(key[m], part[m], lo[m].astype(np.int64) + lead[m] - a))
            if out:
                yield _rows(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            held, wins = [], []
            for row in rows:
                if row["kind"] == _OPEN:
                    held.append(unpack(row["blob"]))
                elif row["kind"] == _WINDOWS:
                    wins.append(unpack(row["blob"]))
                else:
                    yield _rows([tuple(row[x] for x in _ARROW.names)])
            if held:
                yield from ordered(held)
            if wins:
                h, e, ident, key, part, x = _joined(wins)
                order = _sorted(h, e, ident, key, x)
                _, again = _firsts(*(c[order] for c in (h, e, ident, key, x)))
                out = list(_window_marks(*(c[order][again] for c in (key, part, x))))
                if out:
                    yield _rows(out)
    return run


def _chunks(body: np.ndarray, begin: np.ndarray, to: np.ndarray, start: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first byte, end, starts) of runs of phrases of about PIECE bytes."""
    at = 0
    while at < len(begin):
        end = max(at + 1, int(np.searchsorted(to, begin[at] + PIECE, side="right")))
        yield int(begin[at]), int(to[end - 1]), start[at:end]
        at = end


# --------------------------------------------------------------------------- 5 removal
def _remove(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            marked = _Marked()
            for row in rows:
                if row["kind"] == _MARKS:
                    marked.add(row["blob"])
                    continue
                keys, ident, null, size, raw = unpack(row["blob"])
                off = np.concatenate(([0], np.cumsum(size)))
                doc, (_, lo, n, _, _) = marked.of(keys)
                start = off[doc] + lo
                edge = np.zeros(len(raw) + 1, np.int32)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + n + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                head[off[:-1][size > 0]] = gone[off[:-1][size > 0]]  # a span never crosses texts
                lost, spans = (np.concatenate(([0], np.cumsum(x))) for x in (gone, head))
                kept = raw[~gone].tobytes()
                cut = (off - lost[off]).tolist()
                yield pa.RecordBatch.from_arrays([
                    pa.array(ident, mask=null.astype(bool)), pa.array(size), pa.array(lost[off[1:]] - lost[off[:-1]]), pa.array(spans[off[1:]] - spans[off[:-1]]),
                    pa.array([kept[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], schema=_ARROW_RESULT)
    return run


def dedup_bytes(docs: DataFrame, window: int = 100, id_col: str = "doc_id", text_col: str = "text", limits: dict | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of every row: its UTF-8 bytes without those of repeated windows.

    A byte goes if a string of ``window`` (16 or more) bytes that covers it also starts earlier: in a row of smaller id, or in the same
    row further left. Strings are judged on the input and overlap freely; none crosses rows. ``n_spans`` counts the maximal
    removed stretches, ``kept`` (binary) holds the rest. Null and empty texts have no bytes; texts shorter than a window
    lose none. Ids are integers; null comes before all others, rows that repeat an id are ordered by a hash of their text, and rows that repeat id and
    text are judged alike, as one. Other columns (any names) are not read. ``limits`` changes LIMITS (how work is dealt, not what is found).
    """
    if window < 2 * GRAM:
        raise ValueError(f"windows of fewer than {2 * GRAM} bytes are too short for triggers")
    spark, reach, at = docs.sparkSession, window // 2, LIMITS | (limits or {})
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, min(shuffle_partitions(spark), total // PART_BYTES[0]), total // PART_BYTES[1])
    src = src.select(
        F.xxhash64("text", "id").alias("key"), F.pmod(F.hash("id", F.octet_length("text"), "text"), F.lit(parts)).alias("part"), "text",
        F.coalesce("id", F.lit(-(1 << 63))).alias("id"), F.col("id").isNull().alias("absent"))

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "kind", *order)

    texts = src.mapInArrow(_texts, _WIRE)
    marks = stored(dealt(src.mapInArrow(_parse(window, reach, parts, at["local"], at["flush"], at["piece"]), _WIRE)).mapInArrow(_settle(at["hot"]), _WIRE), "phrase-marks")
    opened = dealt(marks.where(F.col("kind") == _ASKS).unionByName(texts), "key", "blob").mapInArrow(_extract(window, reach, parts, at["flush"]), _WIRE)
    repeats = dealt(opened).mapInArrow(_order(window, reach, at["members"]), _WIRE)
    found = dealt(marks.where(F.col("kind") == _MARKS).unionByName(repeats).unionByName(texts)).mapInArrow(_remove(window), _RESULT)
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept")
