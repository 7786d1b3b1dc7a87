"""Substring dedup: word windows are hashed only at difference-cover positions; shared anchors extend to whole windows.

For a difference cover D of the residues modulo v, any two positions i, j have a shift s < v with i+s and j+s both in
D (mod v). So two equal windows of L words share an anchor: an equal run of L - v + 1 words that starts at a cover position of
both documents. Only |D| / v of all positions are hashed (5 of 21 for L = 35).

One linear job, in which text moves by document and hashes by value:
  1. anchors    : each task hashes its anchors; one representative of each distinct hash goes to the hash's part (others
                  of the same task are known to repeat already, so a hash held by a third of all rows stays one row a task);
  2. repeats    : a part marks the hashes that came more than once and sends the positions back to their documents;
  3. extension  : a document meets its marked anchors and hashes every L-word window around them, sent on as in 1;
  4. repeats    : as 2, for whole windows: now the windows that start elsewhere too are known exactly;
  5. removal    : a document drops each word that such a window covers.
Which hashes go on and which are marked at once depends on what shares a flush, so 1 reads its input in the order of the files and 3
its texts in the order of their row keys: a task that is run again after a loss sends the same rows.
Hashes have 64 bits inside their part, parts grow with the input. A part holds a bounded share of the hashes, a document's
own text and positions are all that meets in one place.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import groups, by_part, mix64, pack, powers, shuffle_partitions, span_hashes, text_slices, unpack, word_spans

# fixed values: difference covers (period -> residues), perfect where one exists
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
MIN_ANCHOR = 8  # words
GROUP_BYTES = 16 << 20
_BASE = 0x9E3779B97F4A7C55 | 1
_HASHES, _MARKS, _TEXT, _RESULT = range(4)

_WIRE = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("blob", T.BinaryType()),
    T.StructField("id", T.LongType()), T.StructField("row_key", T.LongType()), T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary()), ("id", pa.int64()), ("row_key", pa.int64()),
                    ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def period(window: int) -> int:
    """Largest known period that leaves anchors of MIN_ANCHOR words (or half the window, if shorter)."""
    return max(v for v in COVERS if window - v + 1 >= min(MIN_ANCHOR, (window + 1) // 2))


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_ARROW)


def run_hashes(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position (equal words, equal hash)."""
    up, down = powers(_BASE, max(1 << 20, len(words) + 1))
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=total[1:])
    return mix64((total[at + size] - total[at]) * down[at])


def _send(h: np.ndarray, key: np.ndarray, part: np.ndarray, pos: np.ndarray, parts: int) -> Iterator[dict]:
    """Chunks of one representative of each distinct hash, by the hash's part; marks of hashes that repeat here."""
    if not len(h):
        return
    _, first, inverse, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    first = np.sort(first)
    shard = (mix64(h[first] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(parts)).astype(np.int64)
    for p, rows in groups(shard):
        r = first[rows]
        yield {"part": p, "kind": _HASHES, "blob": pack(h[r], key[r], part[r], pos[r])}
    yield from _marks(*(x[count[inverse] > 1] for x in (key, part, pos)))


def _marks(key: np.ndarray, part: np.ndarray, pos: np.ndarray) -> Iterator[dict]:
    for p, r in groups(part):
        yield {"part": p, "kind": _MARKS, "blob": pack(key[r], pos[r])}


def _anchors(window: int, parts: int):
    v = period(window)
    size, residues = window - v + 1, np.isin(np.arange(v), COVERS[v])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, dest = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            held, weight = [], 0
            for at, n, raw, off in text_slices(batch.column(2)):
                start, end, first = word_spans(raw, off)
                words = span_hashes(raw, start, end)
                doc = np.repeat(np.arange(n), np.diff(first))
                pos = np.arange(len(words)) - first[doc]
                here = np.flatnonzero(residues[pos % v] & (pos + size <= np.diff(first)[doc]) & (np.diff(first)[doc] >= window))
                held.append((run_hashes(words, here, size), keys[at + doc[here]], dest[at + doc[here]], pos[here].astype(np.int32)))
                weight += len(raw)
                if weight >= GROUP_BYTES:
                    yield _rows(list(_send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)))
                    held, weight = [], 0
            if held:
                yield _rows(list(_send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts)))
    return run


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks of the hashes that reached their part more than once; every other row passes."""
    for _, rows in by_part(batches):
        chunks, other = [], []
        for row in rows:
            if row["kind"] == _HASHES:
                chunks.append(unpack(row["blob"]))
                continue
            other.append(row)
            if len(other) >= 64:
                yield _rows(other)
                other = []
        if chunks:
            h, key, part, pos = (np.concatenate(x) for x in zip(*chunks, strict=True))
            order = np.argsort(h, kind="stable")
            same = h[order[1:]] == h[order[:-1]]
            again = order[np.concatenate((same, [False])) | np.concatenate(([False], same))]
            other += list(_marks(key[again], part[again], pos[again]))
        if other:
            yield _rows(other)


class _Marked:
    """Positions of each document's marks in one part."""

    def __init__(self):
        self.chunks, self.ready = [], None

    def add(self, blob: bytes) -> None:
        self.chunks.append(unpack(blob))

    def of(self, key: int) -> np.ndarray:
        if self.ready is None:
            key_, pos = (np.concatenate(x) for x in zip(*self.chunks, strict=True)) if self.chunks else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            order = np.argsort(key_, kind="stable")
            self.ready, self.chunks = (key_[order], pos[order]), []
        keys, pos = self.ready
        return pos[np.searchsorted(keys, key, "left") : np.searchsorted(keys, key, "right")].astype(np.int64)


def _result(row: dict, words: list[bytes], gone: np.ndarray | None, digest: bool) -> dict:
    kept = b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    return {"part": row["part"], "kind": _RESULT, "id": row["id"], "n_words": len(words), "n_removed": 0 if gone is None else int(gone.sum()),
            "kept": hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")}


def _extend(window: int, parts: int, digest: bool):
    v = period(window)

    def candidates(pos: np.ndarray, n: int) -> np.ndarray:
        """Starts of the windows that hold a marked anchor at a shift below the period."""
        edge = np.zeros(n + 1, dtype=np.int64)
        np.add.at(edge, np.maximum(pos - v + 1, 0), 1)
        np.add.at(edge, pos + 1, -1)
        return np.flatnonzero(np.cumsum(edge)[: max(0, n - window + 1)] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in by_part(batches):
            marked, out, held, weight = _Marked(), [], [], 0
            for row in rows:
                if row["kind"] == _MARKS:
                    marked.add(row["blob"])
                    continue
                text = zstandard.ZstdDecompressor().decompress(row["blob"])
                words, pos = text.split(), marked.of(row["row_key"])
                at = candidates(pos, len(words)) if len(pos) and len(words) >= window else pos[:0]
                if not len(at):
                    out.append(_result(row, words, None, digest))
                else:
                    out.append(row)
                    raw = np.frombuffer(text, np.uint8)
                    start, end, _ = word_spans(raw, np.array([0, len(raw)]))
                    held.append((run_hashes(span_hashes(raw, start, end), at, window), np.full(len(at), row["row_key"]), np.full(len(at), part, np.int32), at.astype(np.int32)))
                weight += len(text)
                if weight >= GROUP_BYTES:
                    yield from _flush(out, held, parts)
                    out, held, weight = [], [], 0
            yield from _flush(out, held, parts)
    return run


def _flush(out: list[dict], held: list, parts: int) -> Iterator[pa.RecordBatch]:
    if held:
        out = out + list(_send(*(np.concatenate(x) for x in zip(*held, strict=True)), parts))
    for k in range(0, len(out), 256):
        yield _rows(out[k : k + 256])


def _remove(window: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            marked, out, weight = _Marked(), [], 0
            for row in rows:
                if row["kind"] == _MARKS:
                    marked.add(row["blob"])
                    continue
                if row["kind"] == _TEXT:
                    words = zstandard.ZstdDecompressor().decompress(row["blob"]).split()
                    pos, edge = marked.of(row["row_key"]), np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, pos, 1)
                    np.add.at(edge, pos + window, -1)
                    row = _result(row, words, np.cumsum(edge)[:-1] > 0, digest)
                out.append(row)
                weight += 100 + len(row["kept"])
                if weight >= GROUP_BYTES:
                    yield _rows(out)
                    out, weight = [], 0
            if out:
                yield _rows(out)
    return run


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        squeeze = zstandard.ZstdCompressor(level=1)
        null = pa.nulls(batch.num_rows)
        blob = pa.array([squeeze.compress(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(2)], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(1), pa.array(np.full(batch.num_rows, _TEXT, np.int32)), blob, batch.column(3), batch.column(0),
             null.cast(pa.int64()), null.cast(pa.int64()), null.cast(pa.string())], schema=_ARROW)


def dedup_substrings(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", digest_only: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every row without the words that a repeated window covers.

    Words are runs of bytes other than ASCII white space, unchanged. A window of ``window`` words repeats if its words also
    start anywhere else, in the same row or another (rows that repeat an id are texts of their own). ``kept`` joins the other
    words by one space; ``digest_only`` gives its SHA-256 instead. Null and empty texts have no words; texts shorter than the
    window lose none. Ids are integers, may be null or repeated; other columns (any names) are not read.
    """
    parts = shuffle_partitions(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    src = src.select(F.xxhash64("text", "id").alias("row_key"), F.pmod(F.hash("id", F.octet_length("text"), "text"), F.lit(parts)).alias("dest"), "text", "id")

    def dealt(df: DataFrame, *order: str) -> DataFrame:
        return df.repartition("part").sortWithinPartitions("part", "kind", *order)

    marks = dealt(src.mapInArrow(_anchors(window, parts), _WIRE)).mapInArrow(_repeats, _WIRE)
    # by row_key too: a task that runs again must flush the same texts together, or a hash may meet its other places in neither run
    met = dealt(marks.unionByName(src.mapInArrow(_texts, _WIRE)), "row_key").mapInArrow(_extend(window, parts, digest_only), _WIRE)
    whole = dealt(dealt(met).mapInArrow(_repeats, _WIRE)).mapInArrow(_remove(window, digest_only), _WIRE)
    return whole.select(F.col("id").alias(id_col), "n_words", "n_removed", "kept")
