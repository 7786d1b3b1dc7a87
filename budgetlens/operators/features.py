"""Feature engineering and preprocessing.

Every transform is a ``fit_*`` that runs one aggregation and returns a frozen
dataclass of scalars, and an ``apply``/column builder that is a projection.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import WINSOR_Q
from ..functions.columns import clip, count_if, flag
from ..functions.quantiles import quantile_map
from .gram import pair_correlations


def fill_unknown(cols: Sequence[str], level: str = "Unknown") -> list:
    """Missing category -> explicit level."""
    return [F.coalesce(F.col(c), F.lit(level)).alias(c) for c in cols]


@dataclass(frozen=True)
class WinsorFit:
    cap: float
    n_above: int


def fit_winsor(df: DataFrame, c: str, q: float = WINSOR_Q) -> WinsorFit:
    """Cap at the exact q-quantile and count the rows above it."""
    cap = quantile_map(df, [c], [q])[(c, round(q, 12))]
    n = df.agg(count_if(F.col(c) > F.lit(cap)).alias("n")).first()["n"]
    return WinsorFit(float(cap), int(n))


def winsorized(c: str, fit: WinsorFit, name: str):
    return clip(c, hi=fit.cap).alias(name)


@dataclass(frozen=True)
class MedianFit:
    medians: dict[str, float]


def fit_median_imputer(df: DataFrame, cols: Sequence[str]) -> MedianFit:
    """Exact medians of many columns in one distributed pass."""
    m = quantile_map(df, cols, [0.5])
    return MedianFit({c: m.get((c, 0.5)) for c in cols})


def imputed(cols: Sequence[str], fit: MedianFit) -> list:
    return [F.coalesce(F.col(c).cast("double"), F.lit(fit.medians[c])).alias(c) for c in cols]


@dataclass(frozen=True)
class ScaleFit:
    center: dict[str, float]
    scale: dict[str, float]


def fit_standard_scaler(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> ScaleFit:
    """Mean and population sd (``ddof=0``, as StandardScaler) or sample sd."""
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[sd(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    return ScaleFit({c: row[f"m{i}"] for i, c in enumerate(cols)},
                    {c: (row[f"s{i}"] if row[f"s{i}"] else 1.0) for i, c in enumerate(cols)})


def varying(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """The columns that hold at least two different non-missing values, in one aggregation."""
    row = df.agg(*[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(cols)]).first() if cols else ()
    return [c for c, v in zip(cols, row) if v]


def fit_zscores(df: DataFrame, cols: Sequence[str]) -> tuple[ScaleFit, MedianFit]:
    """Sample-sd z-scores of median-filled columns; constant and empty columns are dropped."""
    kept = varying(df, cols)
    filled = fit_median_imputer(df, kept)
    return fit_standard_scaler(df.select(*imputed(kept, filled)), kept, ddof=1), filled


def fit_robust_scaler(df: DataFrame, cols: Sequence[str]) -> ScaleFit:
    """Median and interpolated IQR; a zero IQR scales by 1."""
    m = quantile_map(df, cols, [0.25, 0.5, 0.75])
    center, scale = {}, {}
    for c in cols:
        iqr = (m[(c, 0.75)] - m[(c, 0.25)]) if m.get((c, 0.75)) is not None else 0.0
        center[c], scale[c] = m.get((c, 0.5)), (iqr if iqr != 0 else 1.0)
    return ScaleFit(center, scale)


def scaled(cols: Sequence[str], fit: ScaleFit, suffix: str = "") -> list:
    return [((F.col(c) - F.lit(fit.center[c])) / F.lit(fit.scale[c])).alias(f"{c}{suffix}") for c in cols]


def _distinct_levels(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(i, v) for every non-missing level of column i: values are pre-aggregated by task, then one shuffle for all columns."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])).alias("e"))
    return pairs.where("e.v IS NOT NULL").select("e.i", "e.v").distinct()


def fit_levels(df: DataFrame, cols: Sequence[str]) -> dict[str, list]:
    """Sorted distinct levels of each column, all of them: one 0/1 column each, so they have to fit the driver (``sparse`` has no such bound)."""
    if not cols:
        return {}
    found = _distinct_levels(df, cols).collect()
    return {c: sorted(r.v for r in found if r.i == i) for i, c in enumerate(cols)}


def more_levels_than(df: DataFrame, cols: Sequence[str], n: int) -> bool:
    """Whether the columns hold more than ``n`` levels together."""
    return bool(cols) and _distinct_levels(df, cols).limit(n + 1).count() > n


def one_hot(c: str, levels: Sequence[str]) -> list:
    """One 0/1 column per known level; an unknown level is all zeros."""
    return [flag(F.col(c) == F.lit(lv)).alias(f"{c}_{lv}") for lv in levels]


def vif(df: DataFrame, cols: Sequence[str]) -> list[tuple[str, float]]:
    """Variance inflation factors from the correlation matrix (J7); constant columns have none and are left out.

    The p x p correlation matrix is one Gram aggregate (``gram``); its inverse is a
    p x p driver computation (p is the feature count, not the row count).
    Exactly dependent columns (rank deficiency) get ``inf``.
    """
    cols = varying(df, cols)
    p = len(cols)
    if p == 0:
        return []
    r = pair_correlations(df, cols)
    np.fill_diagonal(r, 1.0)
    w, v = np.linalg.eigh(r)
    tol = 1e-10 * max(1.0, float(np.max(np.abs(w))))
    dependent = np.zeros(p, dtype=bool)
    for k in range(p):
        if abs(w[k]) <= tol:
            dependent |= np.abs(v[:, k]) > 1e-6
    if dependent.any():
        inv_diag = np.full(p, np.inf)
        ok = ~dependent
        if ok.any():
            sub = r[np.ix_(ok, ok)]
            inv_diag[ok] = np.diag(np.linalg.inv(sub)) if np.linalg.matrix_rank(sub) == ok.sum() else np.inf
        out = inv_diag
    else:
        out = np.diag(np.linalg.inv(r))
    return [(c, float(x)) for c, x in zip(cols, out)]
