"""Exact top-k by inner product over an impact-ordered index, score at a time.

Components become integers floor(1024 x). Vectors are dealt into index blocks of about BLOCK; in a block each dimension has a
posting list, cut into segments of equal quantised impact (LEVELS of them). For a query, a segment's gain is the most it can
add over the least that its dimension adds. Segments of all dimensions are processed by descending gain into accumulators; after a
step no vector can exceed its accumulator plus what the best unprocessed segment of each dimension could still add. Processing
stops only when that bound proves that all but a few vectors score below the k-th exact score known so far; the possible
members (ties included) are rescored exactly.

The queries (a stated set: every ``every``-th id) are blocks as well. A task holds one query block and streams its share of the
index blocks past it, so memory is one block of each; each share's top k meet by query in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.llm.common import by_part, pack, shuffle_partitions, stored, unpack

BLOCK, QUERY_BLOCK, LEVELS = 4096, 256, 16
STEPS = (0.35, 0.5, 0.65, 0.8, 1.0)  # shares of a block's postings after which the bound is looked at
FEW = 64  # possible members a query may have left in a block when it stops early

_BLOB = T.StructType([T.StructField("block", T.LongType()), T.StructField("blob", T.BinaryType())])
_OUT = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])


def _matrix(vectors: pd.Series) -> np.ndarray:
    """Integer rows; shorter vectors are filled with 0."""
    width = max(1, max(len(v) for v in vectors))
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = np.floor(1024 * np.asarray(v, dtype=np.float64))
    return out


def _pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    x = _matrix(pdf["v"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "blob": [pack(pdf["id"].to_numpy(), np.array(x.shape), x.ravel())]})


def build_block(x: np.ndarray) -> list[np.ndarray]:
    """Postings by dimension and level, segment borders, and the least and largest value of each segment."""
    n, width = x.shape
    low, high = x.min(axis=0), x.max(axis=0)
    level = np.minimum(((x - low) * LEVELS) // np.maximum(high - low + 1, 1), LEVELS - 1)
    order = np.argsort(level, axis=0, kind="stable").T  # dimension x position
    border = np.zeros((width, LEVELS + 1), dtype=np.int64)
    least, most = np.zeros((width, LEVELS), dtype=np.int64), np.zeros((width, LEVELS), dtype=np.int64)
    for d in range(width):
        border[d, 1:] = np.cumsum(np.bincount(level[:, d], minlength=LEVELS))
        for s in np.flatnonzero(np.diff(border[d])):
            part = x[order[d, border[d, s] : border[d, s + 1]], d]
            least[d, s], most[d, s] = part.min(), part.max()
    return [order.astype(np.uint16 if n <= 1 << 16 else np.int32).ravel(), border.ravel(), least.ravel(), most.ravel()]


def _index_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("id")
    x = _matrix(pdf["v"])
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "blob": [pack(pdf["id"].to_numpy(), np.array(x.shape), x.ravel(), *build_block(x))]})


class Block:
    """One index block, opened."""

    def __init__(self, blob: bytes):
        self.ids, shape, x, order, border, least, most = unpack(blob)
        self.n, self.width = shape.tolist()
        self.x, self.order = x.reshape(self.n, self.width), order
        self.border = border.reshape(self.width, LEVELS + 1)
        self.least, self.most = least.reshape(self.width, LEVELS), most.reshape(self.width, LEVELS)
        self.size = np.diff(self.border, axis=1)
        self.start = self.border[:, :-1] + np.arange(self.width)[:, None] * self.n

    def possible(self, w: np.ndarray, own: int, floor: float, k: int) -> np.ndarray:
        """Rows that may score at least ``floor`` and belong to the block's own top k, proven by the bound."""
        up = np.where(w[:, None] > 0, w[:, None] * self.most, w[:, None] * self.least).astype(np.float64)
        if np.abs(up).sum() >= 2.0**52:  # beyond exact float64 sums every row is rescored
            return np.arange(self.n)
        filled = self.size > 0
        base = np.where(filled, up, np.inf).min(axis=1)
        gain = np.where(filled, up - base[:, None], 0.0)
        dim, level = np.nonzero(filled)
        g, size, start = gain[dim, level], self.size[dim, level], self.start[dim, level]
        by = np.argsort(-g, kind="stable")
        dim, g, size, start = dim[by], g[by], size[by], start[by]
        done = np.cumsum(size)
        acc, at = np.full(self.n, base.sum()), 0
        mine = np.flatnonzero(self.ids == own)
        for share in STEPS:
            to = len(g) if share == 1.0 else int(np.searchsorted(done, share * done[-1]))
            if to <= at:
                continue
            s, z = start[at:to], size[at:to]
            spot = np.repeat(s - (np.cumsum(z) - z), z) + np.arange(z.sum())
            acc += np.bincount(self.order[spot], weights=np.repeat(g[at:to], z), minlength=self.n)
            at = to
            more = 0.0
            if to < len(g):
                best = np.zeros(self.width)
                np.maximum.at(best, dim[to:], g[to:])
                more = best.sum()
            acc[mine] = -np.inf
            top = np.argpartition(-acc, k - 1)[:k] if self.n > k else np.flatnonzero(acc > -np.inf)
            top = top[acc[top] > -np.inf]
            exact = np.sort(self.x[top] @ w)
            if len(exact) >= k:
                floor = max(floor, float(exact[-k]))
            left = np.flatnonzero(acc + more >= floor)
            if len(left) <= FEW:
                break
        return left


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_part(batches):
            queries, best = None, []
            for row in rows:
                if row["kind"] == 0:
                    ids, shape, flat = unpack(row["blob"])
                    queries = (ids, flat.reshape(shape.tolist()))
                    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
                elif queries is not None:
                    block = Block(row["blob"])
                    for q, own in enumerate(queries[0].tolist()):
                        w = np.zeros(block.width, dtype=np.int64)
                        both = min(block.width, queries[1].shape[1])
                        w[:both] = queries[1][q, :both]
                        score, ids = best[q]
                        left = block.possible(w, own, float(score[-1]) if len(score) >= k else -np.inf, k)
                        left = left[block.ids[left] != own]
                        score, ids = np.concatenate((score, block.x[left] @ w)), np.concatenate((ids, block.ids[left]))
                        keep = np.lexsort((ids, -score))[:k]
                        best[q] = score[keep], ids[keep]
            if queries is not None:
                n = [len(s) for s, _ in best]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(queries[0], n)), pa.array(np.concatenate([i for _, i in best])), pa.array(np.concatenate([s for s, _ in best]))], names=_OUT.names)
    return run


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` best other rows.

    Score: inner product of the integer vectors (exact while it fits 64 bits), ties to the smaller id. Vectors that are null or
    hold null or non-finite components take no part, nor do null ids. Of rows that repeat an id the smallest vector counts. Shorter
    vectors are filled with 0. A query with fewer than ``k`` other rows gets them all. Other columns (any names) are not read.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad)
    rows = stored(rows.groupBy("id").agg(F.min("v").alias("v")), "topk-vectors")
    asked = rows.where(F.col("id") % every == 0)
    blocks, query_blocks = 1 + rows.count() // BLOCK, 1 + asked.count() // QUERY_BLOCK
    shares = max(1, min(blocks, -(-parts // query_blocks)))

    def deal(df: DataFrame, n: int) -> DataFrame:
        return df.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)))

    index = stored(deal(rows, blocks).groupBy("block").applyInPandas(_index_rows, _BLOB), "topk-index")
    queries = deal(asked, query_blocks).groupBy("block").applyInPandas(_pack_rows, _BLOB)
    part = F.col("q") * shares + F.col("share")
    asks = queries.select(F.col("block").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(0).alias("kind"), "blob")
    answers = index.select(F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("q"), F.pmod("block", F.lit(shares)).alias("share"), F.lit(1).alias("kind"), "blob")
    dealt = asks.select(part.alias("part"), "kind", "blob").unionByName(answers.select(part.alias("part"), "kind", "blob"))
    found = dealt.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(_search(k), _OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
