"""Leakage and identity audit (H1-H8): each check is one aggregation."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag, nz_sum, rate_if, safe_div
from ..functions.quantiles import exact_quantiles


def identity_error(df: DataFrame, residual: str, a: str, b: str) -> DataFrame:
    """max |residual - (a - b)| (H1)."""
    return df.agg(F.max(F.abs(F.col(residual) - (F.col(a) - F.col(b)))).alias("max_abs_error"))


def reconciliation(df: DataFrame, total: str, parts: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """Gap between a total and the sum of its parts: max, median, share within tolerance, corr (H2)."""
    d = df.select(F.col(total).alias("t"), nz_sum(parts).alias("s")).withColumn("gap", F.abs(F.col("t") - F.col("s")))
    base = d.agg(
        F.max("gap").alias("max_gap"),
        rate_if(safe_div(F.col("gap"), F.col("t")) < tolerance).alias("share_within"),
        F.corr("t", "s").alias("corr"),
    )
    med = exact_quantiles(d, ["gap"], [0.5]).select(F.col("q").alias("median_gap"))
    # both sides are one row: stack and fold instead of a cartesian join
    stacked = base.unionByName(med, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("max_gap", "median_gap", "share_within", "corr")])


def reconstruction(df: DataFrame, income: str, parts: Sequence[str], y: str, threshold: float) -> DataFrame:
    """Test A (income minus raw parts) and test B (sum of part/income ratios) vs the target (H3, H4)."""
    spend = nz_sum(parts)
    implied_a = flag(safe_div(F.col(income) - spend, F.col(income)) >= F.lit(float(threshold)))
    ratio_sum = nz_sum([safe_div(F.col(p), F.col(income)) for p in parts])
    implied_b = flag(ratio_sum <= F.lit(1.0 - threshold))
    return df.agg(
        rate_if(implied_a == F.col(y)).alias("agreement_raw_parts"),
        rate_if(implied_b == F.col(y)).alias("agreement_income_ratios"),
    )


def closure_check(df: DataFrame, shares: Sequence[str], rate: str) -> DataFrame:
    """Min/max of the share sums and the largest |corr| of a share with the rate (H5)."""
    s = nz_sum(shares)
    return df.agg(
        F.min(s).alias("min_sum"), F.max(s).alias("max_sum"),
        F.greatest(*[F.abs(F.corr(F.col(c), F.col(rate))) for c in shares]).alias("max_abs_corr"),
    )


def reserved_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each reserved validation column (H6)."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("mean")) for i, c in enumerate(cols)])))


def external_validation(df: DataFrame, flags: Sequence[str], y: str) -> DataFrame:
    """Rate of each reserved flag among target 1 / 0 and the lift (H8)."""
    aggs = []
    for i, c in enumerate(flags):
        v = F.col(c).cast("double")
        aggs += [F.avg(F.when(F.col(y) == 1, v)).alias(f"met{i}"), F.avg(F.when(F.col(y) == 0, v)).alias(f"not{i}")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"met{i}").alias("rate_met"), F.col(f"not{i}").alias("rate_not_met"),
                 (F.col(f"met{i}") - F.col(f"not{i}")).alias("lift"))
        for i, c in enumerate(flags)])))


def plausibility(df: DataFrame, checks) -> DataFrame:
    """Row rule flags: count and share of rows failing each check, in ONE aggregation.

    ``checks`` is a list of ``(name, column, op, value)`` with op in ``< <= = > >=``.
    """
    ops = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, "=": lambda c, v: c == v,
           ">": lambda c, v: c > v, ">=": lambda c, v: c >= v}
    aggs = []
    for i, (name, c, op, v) in enumerate(checks):
        cond = ops[op](F.col(c), F.lit(float(v)))
        aggs += [F.count_if(F.coalesce(cond, F.lit(False))).alias(f"n{i}"), rate_if(cond).alias(f"r{i}")]
    row = df.agg(*aggs)
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("share"))
        for i, (name, *_rest) in enumerate(checks)])))
