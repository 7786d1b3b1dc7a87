"""Quantile and equal-width bins, median split, ordered differences."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import quantile_values


def fit_quantile_edges(df: DataFrame, c: str, k: int) -> list[float]:
    """k+1 exact quantile edges; duplicate edges raise, as ``qcut`` does (F1, F2)."""
    edges = quantile_values(df, c, [i / k for i in range(k + 1)])
    if any(e is None for e in edges):
        raise ValueError(f"no values in {c}")
    if len(set(edges)) != len(edges):
        raise ValueError(f"bin edges must be unique: {edges}")
    return edges


def quantile_bin(c: str, edges: Sequence[float]):
    """Bin id = number of inner edges strictly below x (right-closed, lowest included) (F1)."""
    x = F.col(c)
    inner = [F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]]
    bid = sum(inner[1:], inner[0]) if inner else F.lit(0)
    return F.when(x.isNull() | (x < F.lit(float(edges[0]))) | (x > F.lit(float(edges[-1]))), F.lit(None)).otherwise(bid).cast("int")


def with_quantile_bins(df: DataFrame, c: str, k: int, name: str) -> DataFrame:
    return df.withColumn(name, quantile_bin(c, fit_quantile_edges(df, c, k)))


def linspace(lo: float, hi: float, num: int) -> list[float]:
    """numpy ``linspace``: ``lo + i * step`` with the last point exactly ``hi``."""
    step = (hi - lo) / (num - 1)
    return [lo + i * step for i in range(num - 1)] + [hi]


def equal_width_bin(c: str, edges: Sequence[float]):
    """``pd.cut`` over explicit edges: right-closed, first edge open, outside -> NULL."""
    x = F.col(c)
    inner = [F.when(x > F.lit(float(e)), 1).otherwise(0) for e in edges[1:-1]]
    bid = sum(inner[1:], inner[0]) if inner else F.lit(0)
    return F.when((x > F.lit(float(edges[0]))) & (x <= F.lit(float(edges[-1]))), bid).cast("int")


def median_split(df: DataFrame, c: str, name: str = "is_low") -> DataFrame:
    """Flag rows at or below the exact median."""
    (m,) = quantile_values(df, c, [0.5])
    return df.withColumn(name, (F.col(c) <= F.lit(m)).cast("int"))


def diff_previous(df: DataFrame, order: str, c: str, name: str = "diff") -> DataFrame:
    """Difference to the previous row of a small ordered result."""
    return df.withColumn(name, F.col(c) - F.lag(c).over(Window.orderBy(order)))


def nearest(df: DataFrame, c: str, target: float, key: str) -> DataFrame:
    """Row whose ``c`` is closest to ``target``, first key on ties."""
    return df.agg(F.min_by(F.struct(*[F.col(x) for x in df.columns]),
                           F.struct(F.abs(F.col(c) - F.lit(float(target))), F.col(key))).alias("r")).select("r.*")
