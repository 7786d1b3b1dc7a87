"""Line dedup: a sharded minimal perfect hash over line digests; documents probe its arrays.

1. Each task splits its texts and emits one (128-bit line digest, document) row per document and key.
2. A partially aggregated count gives, for each digest, its number of documents and its largest id.
   Digests of one document only can never lose a line and are left out.
3. Each shard of the other digests becomes one index row: a minimal perfect hash, and the arrays
   fingerprint, count and keeper it points into (about 20 bytes a key, bounded by SHARD_KEYS).
4. Probes stream past their shard's arrays. A shard whose lines are hot gets copies of its (small)
   row, and its probes are dealt over the copies: no task holds a hot key's documents.
5. A document's hits (at most its own lines) go back to it by id and its lines are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import WS, stored
from budgetlens.llm.mphf import PerfectHash

SHARD_KEYS = 200_000  # line occurrences a shard of the index answers for, and probes a copy of it takes

_OCC = T.StructType([T.StructField(c, T.LongType()) for c in ("lo", "hi", "doc")])
_INDEX = T.StructType([
    T.StructField("shard", T.LongType()), T.StructField("copy", T.LongType()), T.StructField("copies", T.LongType()),
    T.StructField("blob", T.BinaryType()),
])
_HITS = T.StructType([T.StructField("doc", T.LongType()), T.StructField("lo", T.LongType())])


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """White space stripped at both ends, A-Z lower-cased; None below ``min_chars`` code points."""
    key = line.strip(WS).lower()
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, docs = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if doc is None or not text.is_valid:
                    continue
                keys = {xxhash.xxh3_128_digest(k) for line in text.as_buffer().to_pybytes().split(b"\n")
                        if (k := line_key(line, min_chars)) is not None}
                digests.extend(keys)
                docs.extend([doc] * len(keys))
            both = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(docs, pa.int64())], names=["lo", "hi", "doc"])
    return run


def _build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    lo, hi = pdf["lo"].to_numpy().view(np.uint64), pdf["hi"].to_numpy().view(np.uint64)
    table = PerfectHash.build(lo, hi)
    at = table.index(lo, hi)
    finger, count, keeper = np.empty(len(at), np.uint64), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
    finger[at], keeper[at] = hi ^ (lo >> np.uint64(1)), pdf["keeper"].to_numpy()
    count[at] = np.minimum(pdf["n"].to_numpy(), 0xFFFFFFFF)
    head = table.pack()
    blob = len(head).to_bytes(8, "little") + head + finger.tobytes() + keeper.tobytes() + count.tobytes()
    copies = 1 + int(pdf["n"].sum()) // SHARD_KEYS
    return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), "copy": range(copies), "copies": copies, "blob": [blob] * copies})


class ShardArrays:
    """One index row, ready to be probed."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:8], "little")
        self.table = PerfectHash.unpack(blob[8 : 8 + size])
        at, n = 8 + size, self.table.n
        self.finger = np.frombuffer(blob, np.uint64, n, at)
        self.keeper = np.frombuffer(blob, np.int64, n, at + 8 * n)
        self.count = np.frombuffer(blob, np.uint32, n, at + 16 * n)

    def dropped(self, lo: np.ndarray, hi: np.ndarray, doc: np.ndarray, min_docs: int) -> np.ndarray:
        at = self.table.index(lo, hi)
        known = at >= 0
        known[known] = self.finger[at[known]] == (hi ^ (lo >> np.uint64(1)))[known]
        out = np.zeros(len(lo), dtype=bool)
        out[known] = (self.count[at[known]] >= min_docs) & (self.keeper[at[known]] != doc[known])
        return out


def _probe(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays, held = None, None
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            shard, copy = col["shard"].to_numpy(), col["copy"].to_numpy()
            index_rows = np.flatnonzero(col["kind"].to_numpy() == 0).tolist()
            lo, hi, doc = (col[c].fill_null(0).to_numpy() for c in ("lo", "hi", "doc"))
            for a, b in zip([-1, *index_rows], [*index_rows, len(shard)], strict=True):
                if a >= 0:
                    arrays, held = ShardArrays(col["blob"][a].as_py()), (shard[a], copy[a])
                if arrays is None or b == a + 1:
                    continue
                s = slice(a + 1, b)
                hit = arrays.dropped(lo[s].view(np.uint64), hi[s].view(np.uint64), doc[s], min_docs)
                hit &= (shard[s] == held[0]) & (copy[s] == held[1])  # a shard without an index row drops nothing
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(doc[s][hit]), pa.array(lo[s][hit])], names=["doc", "lo"])
    return run


def line_drops(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, drops): the digests of the lines that a document loses, for documents that lose any.

    Rows are documents: rows that repeat a doc_id count one by one, and all of them keep or lose a line
    together. A row with a null id has no identity: it is not counted. Null and empty texts hold no key.
    """
    src = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    occ = stored(src.mapInArrow(_occurrences(min_chars), _OCC), "line-occurrences")
    shards = 1 + occ.count() // SHARD_KEYS
    shard = F.pmod(F.col("hi"), F.lit(shards)).alias("shard")
    index = stored(
        occ.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.max("doc").alias("keeper")).where("n >= 2")
        .select(shard, "lo", "hi", "n", "keeper")
        .groupBy("shard").applyInPandas(_build_shard, _INDEX), "line-index")
    probes = (
        occ.select(shard, "lo", "hi", "doc").join(index.where("copy = 0").select("shard", "copies"), "shard")
        .select("shard", F.pmod(F.xxhash64("doc"), F.col("copies")).alias("copy"), F.lit(1).alias("kind"), "lo", "hi", "doc",
                F.lit(None).cast("binary").alias("blob")))
    null = F.lit(None).cast("long")
    rows = index.select("shard", "copy", F.lit(0).alias("kind"), null.alias("lo"), null.alias("hi"), null.alias("doc"), "blob").unionByName(probes)
    hits = rows.repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind").mapInArrow(_probe(min_docs), _HITS)
    return hits.groupBy("doc").agg(F.collect_set("lo").alias("drops"))


def clean_text(text: bytes, drops: set[int], min_chars: int) -> tuple[int, int, bytes]:
    """(lines, dropped lines, text of the others)."""
    lines = text.split(b"\n")
    if not drops:
        return len(lines), 0, text
    kept = []
    for line in lines:
        key = line_key(line, min_chars)
        if key is None or int.from_bytes(xxhash.xxh3_128_digest(key)[:8], "little", signed=True) not in drops:
            kept.append(line)
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def _apply(min_chars: int, with_text: bool, text_at: int, drops_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, dropped, kept = [], [], []
            for text, drops in zip(batch.column(text_at), batch.column(drops_at), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b, c = clean_text(raw, set(drops.as_py()) if drops.is_valid else set(), min_chars)
                n.append(a)
                dropped.append(b)
                kept.append((c.decode() if b or text.is_valid else None) if with_text else hashlib.sha256(c).hexdigest())
            extra = [pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())]
            keep = [i for i in range(batch.num_columns) if i not in (text_at, drops_at)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *extra], names=names)
    return run


def dedup_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text",
                digest_only: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept): every document with its repeated lines dropped.

    A line's key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Keys of at
    least ``min_chars`` code points that at least ``min_docs`` documents hold stay only in the largest
    doc_id that holds them. A null text stays null and an empty one empty: one empty line each.
    ``digest_only``: the SHA-256 of the kept text (null as empty) in place of the text.
    Documents may have any other columns, under any names: only the two named ones are read.
    """
    drops = line_drops(docs, min_docs, min_chars, id_col, text_col)
    src = docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("text"))
    joined = src.join(drops.withColumnRenamed("doc", "c_doc"), F.col("c0") == F.col("c_doc"), "left").select("c0", "text", "drops")
    out = T.StructType([src.schema["c0"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    return joined.mapInArrow(_apply(min_chars, not digest_only, 1, 2, out.names), out).withColumnRenamed("c0", id_col)


def without_repeated_lines(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, the text cleaned as by ``dedup_lines`` (null stays null, no row goes)."""
    drops = line_drops(docs, min_docs, min_chars, id_col, text_col)
    rest = F.struct(*[F.col(c) for c in docs.columns if c != text_col]).alias("rest")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), rest)
    joined = src.join(drops, src["id"] == drops["doc"], "left").select("rest", "text", "drops")
    out = T.StructType([src.schema["rest"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("kept", T.StringType())])
    clean = joined.mapInArrow(_apply(min_chars, True, 1, 2, out.names), out)
    return clean.select(*[F.col("kept").alias(c) if c == text_col else F.col("rest")[c].alias(c) for c in docs.columns])
