"""Scalar column expressions that reproduce numpy/pandas semantics on Spark.

All of them are built-in Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nz_sum(cols: Iterable[str | Column]) -> Column:
    """``df[cols].fillna(0).sum(axis=1)``: NULL counts as zero, never NULL (B1)."""
    terms = [F.coalesce(col(c), F.lit(0.0)) for c in cols]
    if not terms:
        return F.lit(0.0)
    return reduce(lambda a, b: a + b, terms)


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Division that yields NULL instead of raising (ANSI) or inf/NaN (numpy)."""
    return F.try_divide(col(a), col(b))


def to_double(c: str | Column) -> Column:
    """``pd.to_numeric(errors="coerce")``: bad text and NaN become NULL (A3)."""
    v = col(c).cast("string").try_cast("double")
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def clip(c: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """pandas ``clip``: NULL stays NULL."""
    x = col(c)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    return F.when(x.isNull(), F.lit(None).cast("double")).otherwise(out)


def flag(cond: Column) -> Column:
    """Boolean -> INT 0/1 with NULL counted as 0, as a numpy mask does."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def argmax_label(count_cols: Sequence[str], labels: Sequence[str], default: str) -> Column:
    """Label of the first largest count; ``default`` when all counts are zero."""
    counts = F.array(*[F.coalesce(col(c), F.lit(0)).cast("double") for c in count_cols])
    pos = F.array_position(counts, F.array_max(counts))
    lab = F.element_at(F.array(*[F.lit(x) for x in labels]), pos.cast("int"))
    return F.when(F.aggregate(counts, F.lit(0.0), lambda a, b: a + b) > 0, lab).otherwise(F.lit(default))


def lookup(c: str | Column, mapping: dict, default=None) -> Column:
    """Code -> label through a literal map; unmapped codes give ``default``."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = F.try_element_at(m, col(c))
    return out if default is None else F.coalesce(out, F.lit(default))


def first_non_missing(*cols: str | Column) -> Column:
    """The first of the columns that is not missing."""
    return F.coalesce(*[col(c) for c in cols])


def rnd(c: str | Column, d: int = 6) -> Column:
    return F.round(col(c).cast("double"), d)


def adj_skew(c: str | Column) -> Column:
    """pandas ``skew()``: sample-adjusted Fisher-Pearson (aggregate expression)."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def rate_if(cond: Column) -> Column:
    """Mean of a 0/1 mask where NULL counts as False in the denominator."""
    return F.avg(flag(cond).cast("double"))


def linear_combination(cols: Sequence[str], weights: Sequence[float]) -> Column:
    """sum_i w_i * col_i with the weights folded in as literals."""
    terms = [col(c) * F.lit(float(w)) for c, w in zip(cols, weights) if w != 0.0]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)
