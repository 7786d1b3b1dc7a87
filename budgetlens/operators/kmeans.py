"""K-means with many starts and many k at once (N1, N3): one aggregation a step moves the centres of all of them.

Seeding draws each next centre with probability proportional to the squared distance from the nearest earlier one (k-means++), by
keeping the row with the smallest ``-log(u) / weight`` (u is a hash of row, start and step): one pass a centre for all starts, and a start's first k centres
serve every k. A step sends each task's counts, sums and costs, one row a model; rows that have stopped moving (shift of TOLERANCE times the
columns' mean variance, the usual rule) leave the next passes. There is no cap on steps: costs fall at each one, or the model stops.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import SEED
from .boosting import uniform
from .features import fit_standard_scaler, scaled

TOLERANCE = 1e-4
BLOCK_ROWS = 1 << 9
DIRECT_BYTES = 1 << 24  # sums of all tasks that the driver adds up


@dataclass(frozen=True)
class KMeansFit:
    k: int
    start: int
    centres: np.ndarray  # on standardised columns, in a fixed order
    inertia: float
    silhouette: float | None = None


def standardised(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """(id, x): a hash of the key and the columns scaled by their population sd; rows with a missing value are left out."""
    rows = df.na.drop(subset=list(columns))
    fit = fit_standard_scaler(rows, columns, ddof=0)
    return rows.select(F.xxhash64(F.col(key)).alias("id"), F.array(*scaled(columns, fit)).alias("x"))


def packed(rows: DataFrame) -> DataFrame:
    """The same rows in blocks, which every pass reads without taking arrays apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (ids, x)], names=["id", "x"])

    return rows.mapInArrow(run, "id binary, x binary")


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, rows x columns) of ``standardised`` rows, ``packed`` or not."""
    for b in batches:
        if pa.types.is_binary(b.schema.types[0]):
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column(0)[i].as_buffer(), np.int64)
                yield ids, np.frombuffer(b.column(1)[i].as_buffer()).reshape(len(ids), -1)
        elif b.num_rows:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            yield b.column(0).to_numpy(), x


def distances(x: np.ndarray, centres: np.ndarray, norm: np.ndarray | None = None) -> np.ndarray:
    """Squared distances, rows x centres; ``norm``: the rows' squared norms, if known."""
    out = x @ (-2 * centres.T)
    out += ((x * x).sum(axis=1) if norm is None else norm)[:, None]
    out += (centres * centres).sum(axis=1)
    return np.maximum(out, 0.0, out=out)


_DRAW = T.StructType([T.StructField("s", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))])


def seeds(rows: DataFrame, starts: int, k: int, seed: int = SEED) -> np.ndarray:
    """starts x k x columns."""
    chosen: list[list[np.ndarray]] = [[] for _ in range(starts)]
    for step in range(k):
        now = [np.array(c) for c in chosen]

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, tuple] = {}
            for ids, x in _batches(batches):
                for s in range(starts):
                    weight = distances(x, now[s]).min(axis=1) if step else np.ones(len(x))
                    with np.errstate(divide="ignore"):
                        score = -np.log(np.maximum(uniform(ids, seed, s, step), 1e-300)) / weight
                    score = np.where(weight > 0, score, 1e300)  # a copy of a centre: only if nothing else is left
                    least = np.flatnonzero(score == score.min())
                    i = int(least[np.argmin(ids[least])])
                    best[s] = min(best.get(s, (np.inf, 0, None)), (float(score[i]), int(ids[i]), x[i].tolist()), key=lambda v: v[:2])
            yield pa.RecordBatch.from_pylist([{"s": s, "score": a, "id": i, "x": v} for s, (a, i, v) in best.items()],
                                             schema=pa.schema([("s", pa.int32()), ("score", pa.float64()), ("id", pa.int64()), ("x", pa.list_(pa.float64()))]))

        found = rows.mapInArrow(draw, _DRAW).groupBy("s").agg(F.min_by("x", F.struct("score", "id")).alias("x")).collect()  # one row a start
        if not found:
            raise ValueError("no rows to cluster")
        for r in found:
            chosen[r.s].append(np.array(r.x))
    return np.array(chosen)


_PART = T.StructType([T.StructField("m", T.IntegerType()), T.StructField("part", T.BinaryType())])
_ARROW_PART = pa.schema([("m", pa.int32()), ("part", pa.binary())])


def _added(rows: DataFrame, parts, size: int) -> dict[int, np.ndarray]:
    """Sums by model of what ``parts(x)`` yields as (model, flat array) for each batch of rows; ``size``: numbers that a task sends."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for _, x in _batches(batches):
            for m, part in parts(x):
                total[m] = total[m] + part if m in total else part
        yield pa.RecordBatch.from_pylist([{"m": m, "part": v.tobytes()} for m, v in total.items()], schema=_ARROW_PART)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for m, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[m] = total.get(m, 0) + np.frombuffer(part)
        yield pa.RecordBatch.from_pylist([{"m": m, "part": v.tobytes()} for m, v in total.items()], schema=_ARROW_PART)

    found = rows.mapInArrow(add, _PART)
    if rows.rdd.getNumPartitions() * size * 8 > DIRECT_BYTES:
        found = found.repartition("m").mapInArrow(join, _PART)
    total: dict[int, np.ndarray] = {}
    for r in found.collect():  # DIRECT_BYTES, or one row a model
        total[r.m] = total.get(r.m, 0) + np.frombuffer(r.part)
    return total


def _sums(ones: np.ndarray, norm: np.ndarray, models: int, centres: np.ndarray) -> np.ndarray:
    """(cost, rows, column sums) of each centre, as (model, centre, number). ``ones``: the rows after a column of ones; ``centres``:
    of models with equally many, stacked, as what makes a squared distance but for the row's norm."""
    d = (centres @ ones.T).reshape(models, -1, len(ones))  # the few centres are compared by whole rows
    least = d.min(axis=1)
    own = d == least[:, None]
    if np.count_nonzero(own) > least.size:  # ties go to the first centre
        own = np.arange(d.shape[1])[:, None] == d.argmin(axis=1)[:, None]
    own = own.astype(float)
    cost = own @ np.maximum(least + norm, 0.0)[:, :, None]
    return np.concatenate((cost, (own.reshape(-1, len(ones)) @ ones).reshape(models, d.shape[1], -1)), axis=2)


def _parts(x: np.ndarray, now: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """Flat ``_sums`` of every model, those of equal size together, over blocks of rows that stay in a core's cache."""
    sizes: dict[int, list[int]] = {}
    for m, c in now.items():
        sizes.setdefault(len(c), []).append(m)
    stacks = [(models, np.concatenate([np.column_stack(((now[m] * now[m]).sum(axis=1), -2 * now[m])) for m in models])) for models in sizes.values()]
    total: list = [0.0] * len(stacks)
    for a in range(0, len(x), BLOCK_ROWS):
        some = x[a : a + BLOCK_ROWS]
        norm, ones = (some * some).sum(axis=1), np.column_stack((np.ones(len(some)), some))
        for i, (models, centres) in enumerate(stacks):
            total[i] = total[i] + _sums(ones, norm, len(models), centres)
    for (models, _), sums in zip(stacks, total, strict=True):
        for m, part in zip(models, sums, strict=True):
            yield m, part.ravel()


def lloyd(rows: DataFrame, models: list[np.ndarray]) -> list[tuple[np.ndarray, float]]:
    """Final centres and cost of every model, all moved in the same passes. A centre without rows stays where it is."""
    centres, cost, moving = [m.copy() for m in models], [np.inf] * len(models), set(range(len(models)))
    d = models[0].shape[1]
    while moving:
        now = {m: centres[m] for m in moving}
        found = _added(rows, lambda x: _parts(x, now), sum(len(c) for c in now.values()) * (d + 2))
        for m in list(moving):
            part = found[m].reshape(len(centres[m]), d + 2)
            new = np.where(part[:, 1:2] > 0, part[:, 2:] / np.maximum(part[:, 1:2], 1), centres[m])
            here = float(part[:, 0].sum())
            shift = float(((new - centres[m]) ** 2).sum())
            fell, cost[m] = here < cost[m], here
            if shift > TOLERANCE and fell:
                centres[m] = new
            else:
                moving.discard(m)
    return list(zip(centres, cost, strict=True))


def silhouettes(rows: DataFrame, models: list[np.ndarray]) -> list[float]:
    """Silhouette under squared distance of every model over all rows (N2): a pass for the clusters' sums, one for the scores."""
    d = models[0].shape[1]

    def stats(x: np.ndarray):
        for m, c in enumerate(models):
            one = (distances(x, c).argmin(axis=1)[:, None] == np.arange(len(c))).astype(float)
            yield m, np.column_stack((one.sum(axis=0), one.T @ (x * x).sum(axis=1), one.T @ x)).ravel()

    known = {m: v.reshape(len(models[m]), d + 2) for m, v in _added(rows, stats, sum(len(c) for c in models) * (d + 2)).items()}

    def scores(x: np.ndarray):
        norm = (x * x).sum(axis=1)
        for m, c in enumerate(models):
            n, q, s = known[m][:, 0], known[m][:, 1], known[m][:, 2:]
            own = distances(x, c).argmin(axis=1)
            total = np.maximum(n * norm[:, None] - 2 * x @ s.T + q, 0.0)
            at = np.arange(len(x))
            inside = total[at, own] / np.maximum(n[own] - 1, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                other = np.where(n > 0, total / n, np.inf)
            other[at, own] = np.inf
            outside = other.min(axis=1)
            most = np.maximum(inside, outside)
            score = np.where((n[own] > 1) & np.isfinite(outside) & (most > 0), (outside - inside) / np.where(most > 0, most, 1), 0.0)
            yield m, np.array([score.sum(), float(len(x))])

    found = _added(rows, scores, 2 * len(models))
    return [float(found[m][0] / found[m][1]) for m in range(len(models))]


def sweep(df: DataFrame, columns: Sequence[str], key: str, ks: Sequence[int], starts: int = 10, seed: int = SEED) -> list[KMeansFit]:
    """For each k the best of ``starts`` fits by inertia, with its silhouette over all rows."""
    rows = packed(standardised(df, columns, key)).persist()
    try:
        first = seeds(rows, starts, max(ks), seed)
        tried = [(k, s) for k in ks for s in range(starts)]
        done = lloyd(rows, [first[s][:k] for k, s in tried])
        best = [min(((cost, s, c) for (k2, s), (c, cost) in zip(tried, done, strict=True) if k2 == k), key=lambda v: v[:2]) for k in ks]
        ordered = [c[np.lexsort(c.T[::-1])] for _, _, c in best]  # labels don't depend on the start
        sil = silhouettes(rows, ordered)
        return [KMeansFit(k, s, c, cost, v) for k, (cost, s, _), c, v in zip(ks, best, ordered, sil, strict=True)]
    finally:
        rows.unpersist()


def labelled(df: DataFrame, columns: Sequence[str], model: KMeansFit, name: str = "cluster") -> DataFrame:
    """``df`` without rows that miss a column, and the nearest centre of each row (ties to the first)."""
    rows = df.na.drop(subset=list(columns))
    z = scaled(columns, fit_standard_scaler(rows, columns, ddof=0))
    far = [sum(((v - F.lit(float(c))) * (v - F.lit(float(c))) for v, c in zip(z[1:], centre[1:], strict=True)), (z[0] - F.lit(float(centre[0]))) * (z[0] - F.lit(float(centre[0])))) for centre in model.centres]
    return rows.withColumn(name, (F.array_position(F.array(*far), F.least(*far)) - 1).cast("int"))
