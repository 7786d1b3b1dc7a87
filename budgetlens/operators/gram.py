"""Correlations of all pairs of columns from one Gram aggregate.

Tasks turn batches of rows into matrices: with zeros in place of missing values and a 0/1 mask, four matrix products hold
the counts, sums, squares and products of every pair over the rows where both values are present. One vector a task is
added up; the number of columns bounds it, not the number of rows. Values are shifted by the column's mean first, so
large offsets cost no digits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLOTS = 16  # partial sums that reach the driver
FLAT = 1e-13  # a variance below this share of its second moment is rounding


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Pearson correlations, pairwise complete; NaN where a pair has fewer than two rows or a constant side. NaN values stay NaN."""
    p = len(cols)
    if p == 0:
        return np.zeros((0, 0))
    values = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    means = values.agg(*[F.avg(c) for c in values.columns]).first()
    shift = np.array([0.0 if m is None or not np.isfinite(m) else m for m in means])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((4, p, p))
        for b in batches:
            mask = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in b.columns]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy() for c in b.columns])
            x = np.where(mask > 0, x - shift, 0.0)
            total += mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32()), "part": pa.array([total.tobytes()], pa.binary())})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [np.sum([np.frombuffer(b) for b in pdf["part"]], axis=0).tobytes()]})

    parts = values.mapInArrow(task, "slot int, part binary").groupBy("slot").applyInPandas(join, "part binary").collect()  # at most SLOTS rows
    n, s, q, g = np.sum([np.frombuffer(r.part) for r in parts], axis=0).reshape(4, p, p) if parts else np.zeros((4, p, p))
    spread = n * q - s * s
    with np.errstate(invalid="ignore", divide="ignore"):
        spread = np.where((n < 2) | (spread <= FLAT * n * q), np.nan, spread)
        r = (n * g - s * s.T) / np.sqrt(spread * spread.T)
    return np.clip(r, -1.0, 1.0)
