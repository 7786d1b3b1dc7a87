"""Shared helpers: scratch tables in the cluster's folder, and numpy views of Arrow text batches.

The vectorised helpers work on one contiguous UTF-8 buffer per slice of a batch, so a
task's memory is bounded by ``SLICE_BYTES`` plus its longest single text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from budgetlens.session import checkpoint_dir

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 20  # positions per power table

WS = b" \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]
IS_WS = np.zeros(256, dtype=bool)
IS_WS[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32


# --------------------------------------------------------------------------- scratch tables
def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/budgetlens-llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends at the files."""
    path = scratch(df.sparkSession, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --------------------------------------------------------------------------- Arrow text slices
def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets) of slices of at most ``limit`` bytes (one text at least); null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to - at, raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (multiply / xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int = _BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        inverse = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inverse):
            f = np.full(n, b, dtype=np.uint64)
            f[0] = 1
            out.append(np.cumprod(f, dtype=np.uint64))
        _POWERS[base] = (out[0], out[1])
    return _POWERS[base]


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, lut: np.ndarray = SAME, base: int = _BASE) -> np.ndarray:
    """64-bit hash of each byte span [start, end) after the byte map ``lut``; equal bytes, equal hash."""
    n = len(raw)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(base)
    value = lut[raw].astype(np.uint64) + np.uint64(1)
    total = np.zeros(n + 1, dtype=np.uint64)
    for at in range(0, n, _BLOCK):
        part = value[at : at + _BLOCK]
        part *= up[: len(part)]
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[start]) * down[start % _BLOCK]
    for i in np.flatnonzero(start // _BLOCK != (np.maximum(end, start + 1) - 1) // _BLOCK):
        x, p = 0, 1  # a span across a block border: its powers restart there, so it is summed on its own
        for b in lut[raw[start[i] : end[i]]].tolist():
            x = (x + (b + 1) * p) & 0xFFFFFFFFFFFFFFFF
            p = (p * base) & 0xFFFFFFFFFFFFFFFF
        h[i] = x
    return mix64(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def word_spans(raw: np.ndarray, offsets: np.ndarray, is_gap: np.ndarray = IS_WS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of non-gap bytes, and the first word index of each document (+ total)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~is_gap[raw]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    first = inside.copy()
    first[1:] &= cut[1:n] | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= cut[1:n] | ~inside[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def sequence_hash(parts: list[np.ndarray], salt: int = 0) -> np.ndarray:
    """Order-sensitive 64-bit hash of equally long columns of 64-bit hashes."""
    acc = np.full(len(parts[0]), (salt * 2 + 1) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for k, p in enumerate(parts):
        acc += p * np.uint64(((2 * k + 3 + salt) * 0x9FB21C651E98DF25 | 1) & 0xFFFFFFFFFFFFFFFF)
    return mix64(acc)


def crc_remainder(column: str, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus`` (the fold rule of the contracts)."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def padded(raw: np.ndarray, offsets: np.ndarray, pad: int) -> tuple[bytes, np.ndarray]:
    """The slice's texts with ``pad`` spaces before, between and after them, and the start of each in that buffer."""
    data, cuts, gap = raw.tobytes(), offsets.tolist(), b" " * pad
    out = gap + gap.join([data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]) + gap
    return out, offsets[:-1] + pad * np.arange(1, len(offsets))


#: Byte map to lower-case letters, digits and non-ASCII bytes; everything else becomes a space.
LETTERS = bytes(b if b >= 128 or chr(b).isalnum() and chr(b).islower() or 48 <= b < 58 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def ngram_codes(text: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Bucket of each byte n-gram (n up to 7): a multiplicative hash to ``bits`` bits."""
    size = len(text) - n + 1
    x = text[:size].astype(np.uint64)
    for k in range(1, n):
        x |= text[k : k + size].astype(np.uint64) << np.uint64(8 * k)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x >>= np.uint64(64 - bits)
    return x.astype(np.int64)


def bounded_sample(df: DataFrame, class_col: str, per_class: dict, id_col: str, seed: int) -> DataFrame:
    """About ``per_class[c]`` rows of class c (all, if fewer): a hash of the id decides, the same at every run."""
    counts = {r[0]: r[1] for r in df.groupBy(class_col).count().collect()}  # one row a class
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for c, n in counts.items():
        share = F.when(F.col(class_col) == F.lit(c), F.lit(min(1.0, per_class.get(c, 0) / n))).otherwise(share)
    return df.where(draw < share)


# --------------------------------------------------------------------------- packed rows between tasks
def pack(*arrays: np.ndarray) -> bytes:
    """One blob of several arrays: each compressed on its own, or as it is where that is shorter."""
    out = [len(arrays).to_bytes(2, "little")]
    for a in arrays:
        raw = np.ascontiguousarray(a).tobytes()
        small = zstandard.ZstdCompressor(level=1).compress(raw) if len(raw) > 32 else raw
        plain = len(small) >= len(raw)
        body = raw if plain else small
        out += [a.dtype.str.encode().ljust(4), bytes([plain]), len(body).to_bytes(8, "little"), body]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    at, out = 2, []
    for _ in range(int.from_bytes(blob[:2], "little")):
        kind, plain, size = np.dtype(blob[at : at + 4].decode().strip()), blob[at + 4], int.from_bytes(blob[at + 5 : at + 13], "little")
        body = blob[at + 13 : at + 13 + size]
        out.append(np.frombuffer(body if plain else zstandard.ZstdDecompressor().decompress(body), kind))
        at += 13 + size
    return out


def groups(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, positions in order) of each distinct value."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    border = np.flatnonzero(np.diff(target[order])) + 1
    for part in np.split(order, border):
        yield int(target[part[0]]), part


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows (as dicts) of partition-sorted batches, grouped by their ``part`` column without holding a group."""
    rows = (dict(zip(b.schema.names, r, strict=True)) for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
    return groupby(rows, key=itemgetter("part"))
