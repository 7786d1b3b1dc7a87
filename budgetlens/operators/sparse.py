"""Categories with very many levels: level indices by join, and linear fits without any p x p array.

``index_levels`` numbers the distinct levels of all columns in one distributed pass; the numbers stay a table. ``encode``
joins them to the rows, so a row carries a short list of level numbers beside its numeric features, whatever the width.
``fit_sparse`` minimises the objective of ``linear.fit_linear`` by Newton steps whose systems are solved by conjugate
gradients: each needs Hessian-vector products only, and one product is one pass over the rows. Tasks add up vectors of the
model's length; these are added by blocks, so no task holds more than some blocks, and the driver keeps a few vectors.

Numbers: ``[numeric features, levels, intercept]``. Missing and unknown levels have no number and count as all zeros.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from copy import copy
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import row_numbers
from .linear import TOLERANCE

BLOCK = 16_384  # numbers of a vector that are added up together
DIRECT_BYTES = 64 << 20  # partial vectors up to this size in all go to the driver without another shuffle
APART_BYTES = 8 << 20  # a vector from which models are fitted one after another, so that the driver holds one model's vectors
PART_BYTES = 64 << 20  # rows kept in a partition
MODEL_BYTES = 512 << 20  # a model vector goes to every task, so its size is checked; beyond this a fit raises


@dataclass(frozen=True)
class LevelIndex:
    """``table``: (column, level, n, idx), one row a level; ``idx`` counts from 0 through the columns in order, levels sorted."""
    columns: tuple[str, ...]
    table: DataFrame
    width: int


def index_levels(df: DataFrame, columns: Sequence[str]) -> LevelIndex:
    """Number the distinct non-missing levels of ``columns`` (as text); nothing but one count a column reaches the driver."""
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("_col"), F.col(c).cast("string").alias("level")) for i, c in enumerate(columns)])))
    counts = pairs.where("level IS NOT NULL").groupBy("_col", "level").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    sizes = {r["_col"]: r["m"] for r in counts.groupBy("_col").agg(F.count(F.lit(1)).alias("m")).collect()}  # one row a column
    start, width = [], 0
    for i in range(len(columns)):
        start.append(width)
        width += sizes.get(i, 0)
    at = F.get(F.array(*[F.lit(s).cast("long") for s in start]), F.col("_col"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("_col"))
    table = row_numbers(counts, ["level"], ["_col"], name="_rank").select(name.alias("column"), "level", "n", (at + F.col("_rank") - 1).alias("idx"))
    return LevelIndex(tuple(columns), table.checkpoint(), width)


def encode(df: DataFrame, index: LevelIndex, out: str = "levels") -> DataFrame:
    """Add ``out``, the numbers of each row's known levels.

    One left join a column on the level's text. Catalyst broadcasts the level table only under the session's size
    threshold; beyond it AQE splits the partition of a level (or of missing values) that many rows share.
    """
    found = df
    for i, c in enumerate(index.columns):
        # one name a column that no column of the rows has
        level, number = f"_level_{i}_", f"_number_{i}_"
        own = index.table.where(F.col("column") == c).select(F.col("level").alias(level), F.col("idx").alias(number))
        found = found.join(own, F.col(c).cast("string") == F.col(level), "left").drop(level)
    numbers = F.array_compact(F.array(*[F.col(f"_number_{i}_") for i in range(len(index.columns))]))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], numbers.alias(out))


@dataclass(frozen=True)
class SparseModel:
    numeric: np.ndarray
    level: np.ndarray
    intercept: float
    iterations: int  # Newton steps
    products: int  # Hessian-vector products
    gradient: float  # largest absolute entry at the end, relative to the start
    objective: float

    def margin(self, df: DataFrame, features: str = "x", levels: str = "levels", out: str = "margin") -> DataFrame:
        """Add the margin of encoded rows; one broadcast of the checked model vector."""
        shared = df.sparkSession.sparkContext.broadcast(np.concatenate((self.numeric, self.level, [self.intercept])))
        d = len(self.numeric)

        @F.arrow_udf("double")
        def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for x, idx in batches:
                yield pa.array(_margins(_matrix(x, d), *_flat(idx), shared.value))

        return df.withColumn(out, score(F.col(features), F.col(levels)))

    def level_weights(self, index: LevelIndex) -> DataFrame:
        """(column, level, n, idx, weight): the fitted weights back at their levels."""
        rows = pa.table({"idx": np.arange(len(self.level), dtype=np.int64), "weight": self.level})
        return index.table.join(index.table.sparkSession.createDataFrame(rows), "idx")


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(x), d)


def _flat(idx: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as (row, number) pairs."""
    return np.repeat(np.arange(len(idx)), np.diff(idx.offsets.to_numpy())), idx.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _margins(x: np.ndarray, row: np.ndarray, flat: np.ndarray, w: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    return x @ w[:d] + w[-1] + np.bincount(row, weights=w[d:].take(flat), minlength=len(x))


def _back(x: np.ndarray, row: np.ndarray, flat: np.ndarray, a: np.ndarray, total: np.ndarray) -> None:
    """Add the transposed rows times ``a`` to ``total``."""
    d = x.shape[1]
    total[:d] += a @ x
    np.add.at(total[d:], flat, a.take(row))
    total[-1] += a.sum()


def _slopes(m: np.ndarray, y: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss of each row, its first and second derivative by the margin; ``y`` is -1 or 1."""
    t = y * m
    if loss == "log":
        p = 1 / (1 + np.exp(np.clip(t, -700, 700)))
        return np.logaddexp(0, -t), -y * p, p * (1 - p)
    gap = np.maximum(0.0, 1 - t)
    return gap * gap, -2 * y * gap, 2.0 * (gap > 0)


_KEPT = "n bigint, x binary, row binary, flat binary, y binary, s binary"


def _blocks(rows: DataFrame, d: int) -> DataFrame:
    """Rows (x, levels, y, s) as blocks of flat numbers, dealt out evenly: a scan may hand all rows to few tasks, and lists cost more to read than to add up."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                row, flat = _flat(b.column("levels"))
                arrays = {"x": _matrix(b.column("x"), d), "row": row.astype(np.int32), "flat": flat.astype(np.int32), "y": b.column("y").to_numpy(), "s": b.column("s").to_numpy()}
                yield pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in arrays.items()}})

    spark, bytes_a_row = rows.sparkSession, 8 * (d + 2)
    packed = rows.mapInArrow(pack, _KEPT).persist()
    try:
        size = packed.agg(F.sum(F.col("n") * bytes_a_row + F.length("row") * 2)).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, -(-size // PART_BYTES))
        return packed.repartition(parts).checkpoint().persist()
    finally:
        packed.unpersist()


class _Rows:
    """Encoded rows of a fit; each call is one pass that returns a vector summed over all rows."""

    def __init__(self, rows: DataFrame, d: int, width: int, loss: str):
        self.rows, self.d, self.length, self.loss = _blocks(rows, d), d, d + width + 1, loss
        self.tasks = self.rows.rdd.getNumPartitions()
        self.context = rows.sparkSession.sparkContext

    def of(self, loss: str) -> "_Rows":
        """The same kept rows under another loss."""
        out = copy(self)
        out.loss = loss
        return out

    def _sum(self, size: int, add, *vectors: np.ndarray) -> np.ndarray:
        shared, d = self.context.broadcast(vectors), self.d
        direct = self.tasks * size * 8 <= DIRECT_BYTES
        slots = 1 if self.tasks <= 64 else int(np.ceil(np.sqrt(self.tasks)))
        step = size if direct else BLOCK

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            total, vectors = np.zeros(size), shared.value
            for b in batches:
                for i in range(b.num_rows):
                    x, row, flat, y, s = (np.frombuffer(b.column(k)[i].as_buffer(), t) for k, t in zip(("x", "row", "flat", "y", "s"), (float, np.int32, np.int32, float, float), strict=True))
                    add(total, x.reshape(len(y), d), row, flat, y, s, *vectors)
            slot, starts = TaskContext.get().partitionId() % slots, range(0, size, step)
            for i, lo in enumerate(starts):
                yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], pa.int32()), "block": pa.array([i], pa.int32()),
                                                  "part": pa.array([total[lo:lo + step].tobytes()], pa.binary())})

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.sum([np.frombuffer(b) for b in pdf["part"]], axis=0)
            return pd.DataFrame({"slot": [0], "block": [int(pdf["block"].iloc[0])], "part": [total.tobytes()]})

        schema = "slot int, block int, part binary"
        parts = self.rows.mapInArrow(task, schema)
        if not direct:
            parts = parts.groupBy("slot", "block").applyInPandas(join, schema)
            if slots > 1:
                parts = parts.groupBy("block").applyInPandas(join, schema)
        total = np.zeros(size)
        # direct: at most DIRECT_BYTES; otherwise one vector of the model's length, a long one by partitions
        for r in parts.toLocalIterator() if size * 8 > APART_BYTES else parts.collect():
            total[r.block * step:r.block * step + len(r.part) // 8] += np.frombuffer(r.part)
        shared.destroy()
        return total

    def point(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss, gradient and the Hessian's diagonal at ``w``."""
        k, loss = self.length, self.loss

        def add(total, x, row, flat, y, s, w):
            value, slope, curve = _slopes(_margins(x, row, flat, w), y, loss)
            total[0] += s @ value
            _back(x, row, flat, s * slope, total[1:1 + k])
            _back(x * x, row, flat, s * curve, total[1 + k:])

        total = self._sum(1 + 2 * k, add, w)
        return float(total[0]), total[1:1 + k], total[1 + k:]

    def product(self, w: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The Hessian at ``w`` times ``v``."""
        loss = self.loss

        def add(total, x, row, flat, y, s, w, v):
            curve = _slopes(_margins(x, row, flat, w), y, loss)[2]
            _back(x, row, flat, s * curve * _margins(x, row, flat, v), total)

        return self._sum(self.length, add, w, v)


def fit_sparse(df: DataFrame, width: int, c: float, loss: str = "log", features: str = "x", levels: str = "levels", label: str = "label", weight: str | None = None) -> SparseModel:
    """``fit_sparse_each`` of one model."""
    return fit_sparse_each(df, width, [(c, loss)], features, levels, label, weight)[0]


def fit_sparse_each(df: DataFrame, width: int, models: Sequence[tuple[float, str]], features: str = "x", levels: str = "levels", label: str = "label", weight: str | None = None) -> list[SparseModel]:
    """Fit encoded rows with a 0/1 label, a model for each (C, loss); the same optimum as ``fit_linear`` on one-hot columns.

    ``features`` is an array of numeric features (may be empty), ``levels`` the numbers of ``encode``, ``width`` their
    count. All models read one kept copy of the rows, side by side. Rows without a label are left out. Without rows, with a
    model above MODEL_BYTES, or if the gradient can't be brought below TOLERANCE, raises.
    """
    kept = df.where(F.col(label).isNotNull())
    first = kept.select(F.size(features).alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    if (first.d + width + 1) * 8 > MODEL_BYTES:
        raise ValueError(f"{first.d + width} features take more than {MODEL_BYTES} bytes a vector")
    s: Column = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = _Rows(kept.select(F.col(features).cast("array<double>").alias("x"), F.col(levels).cast("array<bigint>").alias("levels"),
                             (F.col(label) * 2 - 1).cast("double").alias("y"), s.alias("s")), first.d, width, "log")
    try:
        with ThreadPoolExecutor(max_workers=min(4, len(models)) if rows.length * 8 <= APART_BYTES else 1) as ex:
            return list(ex.map(lambda m: _newton_cg(rows.of(m[1]), first.d, m[0]), models))
    finally:
        rows.rows.unpersist()


def _newton_cg(rows: _Rows, d: int, c: float) -> SparseModel:
    ridge = np.ones(rows.length)
    if rows.loss == "log":
        ridge[-1] = 0.0

    def at(w):
        value, grad, diagonal = rows.point(w)
        return 0.5 * float(ridge @ (w * w)) + c * value, ridge * w + c * grad, ridge + c * diagonal

    w = np.zeros(rows.length)
    value, grad, diagonal = at(w)
    start, steps, products = max(np.abs(grad).max(), 1e-300), 0, 0
    while np.abs(grad).max() > TOLERANCE * start:
        # conjugate gradients, scaled by the diagonal; the nearer the optimum, the smaller the residual they have to reach
        scale = 1 / np.maximum(diagonal, 1e-12)
        step, residual = np.zeros_like(w), -grad
        z = scale * residual
        direction, old = z.copy(), float(residual @ z)  # long vectors: they are changed in place
        goal = old * min(0.25, np.abs(grad).max() / start) ** 2
        while old > goal:
            turned = rows.product(w, direction)
            turned *= c
            turned += ridge * direction
            products += 1
            curve = float(direction @ turned)
            if curve <= 0:  # flat to rounding: what was found so far is a descent direction
                break
            step += old / curve * direction
            turned *= old / curve
            residual -= turned
            np.multiply(scale, residual, out=z)
            new = float(residual @ z)
            direction *= new / old
            direction += z
            old = new
        if not step.any():
            step = scale * -grad
        del scale, residual, z, direction
        turned = None
        size, steps = 1.0, steps + 1
        while True:
            trial = at(w + size * step)
            if trial[0] <= value + 1e-4 * size * float(grad @ step) or trial[0] <= value * (1 + 1e-14) and np.abs(trial[1]).max() < np.abs(grad).max():
                break
            size /= 2
            if size < 1e-10:
                raise RuntimeError(f"no descent at gradient {np.abs(grad).max() / start:.3g} of its start after {steps} steps")
        w, (value, grad, diagonal) = w + size * step, trial
    return SparseModel(w[:d], w[d:-1], float(w[-1]), steps, products, float(np.abs(grad).max() / start), value)
