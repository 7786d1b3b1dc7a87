"""L2-regularised linear classifiers by distributed Newton steps.

Objective, as the study's solvers state it: ``|w|^2 / 2 + C * sum(s_i * loss(y_i, f_i))``, with log loss (free
intercept) or squared hinge loss (the intercept is penalised like a weight). One pass over the rows gives loss,
gradient and Hessian for every fit at hand: every task adds up its rows, the driver adds up the tasks' sums (beyond
DIRECT_BYTES slots of tasks do in a second step) and solves a (p + 1) x (p + 1) system (p is the number of features, not of rows). Steps are halved until the objective
falls. There is no iteration cap: a fit ends when its gradient is below tolerance, or raises.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-8  # largest gradient entry, relative to the gradient at the start
SLOTS = 16  # partial sums that reach the driver
DIRECT_BYTES = 1 << 24  # tasks' sums that the driver adds up without slots


@dataclass(frozen=True)
class LinearModel:
    coef: np.ndarray
    intercept: float
    iterations: int
    gradient: float  # largest absolute entry at the end, relative to the start

    def margin(self, features: str = "features") -> Column:
        weights = F.array(*[F.lit(float(c)) for c in self.coef])
        products = F.zip_with(vector_to_array(F.col(features)), weights, lambda x, w: x * w)
        return F.aggregate(products, F.lit(float(self.intercept)), lambda a, x: a + x)

    def probability(self, features: str = "features") -> Column:
        return 1 / (1 + F.exp(-self.margin(features)))


def _point(x: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray, loss: str) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and Hessian of the data term at ``w`` (intercept last); ``y`` is -1 or 1."""
    m = y * (x @ w[:-1] + w[-1])
    if loss == "log":
        p = 1 / (1 + np.exp(np.clip(m, -700, 700)))
        value, slope, curve = np.logaddexp(0, -m), -y * p, p * (1 - p)
    else:
        gap = np.maximum(0.0, 1 - m)
        value, slope, curve = gap * gap, -2 * y * gap, 2.0 * (gap > 0)
    z = np.column_stack((x, np.ones(len(x))))
    return float(s @ value), z.T @ (s * slope), (z * (s * curve)[:, None]).T @ z


def _pass(rows: DataFrame, tasks: int, points: Sequence[np.ndarray], loss: str) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and Hessian at each of the points, from one pass over the blocks of rows."""
    k = len(points[0])
    size = 1 + k + k * k

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, slot = np.zeros((len(points), size)), 0
        for batch in batches:
            for b in range(batch.num_rows):
                x, y, s = (np.frombuffer(batch.column(i)[b].as_buffer()) for i in range(3))
                x, slot = x.reshape(-1, k - 1), batch.column(3)[b].as_py()
                for i, w in enumerate(points):
                    value, grad, hess = _point(x, y, s, w, loss)
                    total[i] += np.concatenate(([value], grad, hess.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "part"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [np.sum([np.frombuffer(b) for b in pdf["part"]], axis=0).tobytes()]})

    parts = rows.mapInArrow(add, "slot int, part binary")
    if tasks * len(points) * size * 8 > DIRECT_BYTES:
        parts = parts.groupBy("slot").applyInPandas(join, "part binary")
    total = np.zeros((len(points), size))
    for r in parts.collect():  # DIRECT_BYTES, or at most SLOTS rows
        total += np.frombuffer(r.part).reshape(total.shape)
    return [(float(t[0]), t[1 : 1 + k], t[1 + k :].reshape(k, k)) for t in total]


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (x, y, s, slot) in blocks, which every pass reads without taking arrays apart."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y, s, slot = b.columns
                numbers = x.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False), y.to_numpy(zero_copy_only=False), s.to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*(pa.array([n.tobytes()], pa.binary()) for n in numbers), slot.slice(0, 1)], names=["x", "y", "s", "slot"])
    return rows.mapInArrow(run, "x binary, y binary, s binary, slot int")


def fit_linear(df: DataFrame, c: float, loss: str = "log", features: str = "features", label: str = "label", weight: str | None = None) -> LinearModel:
    """Fit on rows with a feature vector and a 0/1 label; raises if the gradient can't be brought below TOLERANCE."""
    return fit_linear_each(df, [c], loss, features, label, weight)[0]


def fit_linear_each(df: DataFrame, cs: Sequence[float], loss: str = "log", features: str = "features", label: str = "label", weight: str | None = None) -> list[LinearModel]:
    """One fit for each C, all over one kept copy of the rows and in the same passes."""
    first = df.select(F.size(vector_to_array(F.col(features))).alias("p")).first()
    if first is None:
        raise ValueError("no rows to fit")
    s = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = _packed(df.select(vector_to_array(F.col(features)).alias("x"), (F.col(label) * 2 - 1).cast("double").alias("y"), s.alias("s"),
                             (F.spark_partition_id() % SLOTS).alias("slot"))).persist()
    try:
        tasks = rows.rdd.getNumPartitions()
        steps = [_newton(first.p, c, loss) for c in cs]
        asked, done = {i: next(step) for i, step in enumerate(steps)}, {}
        while asked:
            found = dict(zip(asked, _pass(rows, tasks, list(asked.values()), loss), strict=True))
            for i, sums in found.items():
                try:
                    asked[i] = steps[i].send(sums)
                except StopIteration as end:
                    done[i] = end.value
                    del asked[i]
        return [done[i] for i in range(len(steps))]
    finally:
        rows.unpersist()


def _newton(p: int, c: float, loss: str) -> Generator[np.ndarray, tuple, LinearModel]:
    """Yields the points at which it is sent loss, gradient and Hessian of the data term; returns the model."""
    ridge = np.ones(p + 1)
    if loss == "log":
        ridge[-1] = 0.0

    def at(w):
        value, grad, hess = yield w
        return 0.5 * float(ridge @ (w * w)) + c * value, ridge * w + c * grad, np.diag(ridge) + c * hess

    w = np.zeros(p + 1)
    value, grad, hess = yield from at(w)
    start, iteration = max(np.abs(grad).max(), 1e-300), 0
    while np.abs(grad).max() > TOLERANCE * start:
        step = np.linalg.lstsq(hess, -grad, rcond=None)[0]
        size, iteration = 1.0, iteration + 1
        while True:
            new = yield from at(w + size * step)
            if new[0] <= value + 1e-4 * size * float(grad @ step) or new[0] <= value and np.abs(new[1]).max() < np.abs(grad).max():
                break
            size /= 2
            if size < 1e-10:
                raise RuntimeError(f"no descent at gradient {np.abs(grad).max() / start:.3g} of its start after {iteration} steps")
        w, (value, grad, hess) = w + size * step, new
    return LinearModel(w[:-1], float(w[-1]), iteration, float(np.abs(grad).max() / start))
