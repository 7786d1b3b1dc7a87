"""Profiling and grouped statistics.

Per-column statistics of many columns are fused into ONE aggregation and then
unpivoted, instead of one job per column. Percentiles are exact (see
``functions.quantiles``). Group tables are small results of a shuffle
aggregation with map-side partial aggregation.
"""

from __future__ import annotations

from typing import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import adj_skew, flag, rate_if
from ..functions.quantiles import exact_quantiles, quantile_wide
from .gram import pair_correlations


def _unpivot_stats(row_df: DataFrame, cols: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """One-row frame with columns ``<stat>__<col>`` -> long (column, stat...)."""
    arr = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{s}__{c}").alias(s) for s in stats]) for c in cols
    ])
    return row_df.select(F.inline(arr))


def describe(df: DataFrame, cols: Sequence[str], pcts: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std (sample), min, percentiles, max, adjusted skew per column."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"n__{c}"), F.avg(x).alias(f"mean__{c}"), F.stddev_samp(x).alias(f"std__{c}"),
            F.min(x).alias(f"min__{c}"), F.max(x).alias(f"max__{c}"), adj_skew(x).alias(f"skew__{c}"),
        ]
    stats = ["n", "mean", "std", "min", "max", "skew"]
    base = _unpivot_stats(df.agg(*aggs), cols, stats)
    names = [f"p{round(p * 100, 4):g}".replace(".", "_") for p in pcts]
    if not pcts:
        return base.select("column", "n", "mean", "std", "min", "max", "skew")
    q = quantile_wide(df, cols, pcts, names=names)
    return base.join(F.broadcast(q), "column", "left").select("column", "n", "mean", "std", "min", *names, "max", "skew")


def scale_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """min, max, std, skew and range per column plus the largest/smallest std ratio."""
    d = describe(df, cols, pcts=())
    w = Window.partitionBy()
    return d.select(
        "column", "min", "max", "std", "skew", (F.col("max") - F.col("min")).alias("range"),
        (F.max("std").over(w) / F.min("std").over(w)).alias("std_ratio"),
    )


def zero_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of rows equal to zero per column; NULL counts as not zero."""
    row = df.agg(*[rate_if(F.col(c) == 0).alias(f"z__{c}") for c in cols])
    return _unpivot_stats(row, cols, ["z"]).withColumnRenamed("z", "zero_rate")


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with any NULL: count and percent (E5)."""
    cols = list(cols or df.columns)
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(f"m__{c}") for c in cols])
    long = row.select("_n", F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m__{c}").alias("n_missing")) for c in cols])))
    return long.filter(F.col("n_missing") > 0).select(
        "column", "n_missing", (F.col("n_missing") * 100.0 / F.col("_n")).alias("pct")
    )


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Duplicate keys and fully duplicated rows (E6). Whole rows meet only for keys that were seen more than once."""
    keys = df.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    more = keys.where("_c > 1").select(F.col(key).alias("_k"))
    twins = df.join(more, F.col(key).eqNullSafe(F.col("_k")), "left_semi").groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_d"))
    by_key = keys.agg((F.coalesce(F.sum("_c"), F.lit(0)) - F.count(key)).alias("dup_keys"))
    by_row = twins.agg(F.coalesce(F.sum("_d"), F.lit(0)).alias("dup_rows"))
    return by_key.unionByName(by_row, allowMissingColumns=True).agg(F.max("dup_keys").alias("dup_keys"), F.max("dup_rows").alias("dup_rows"))


def cardinality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values and NULL count per column (E7): one count by (column, value), pre-aggregated in each task."""
    pair = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in cols]))
    values = df.select(pair).groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    return values.groupBy("column").agg(F.count("v").alias("levels"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0)).alias("n_missing"))


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """Counts, percent and imbalance ratio (largest / smallest) of one column."""
    g = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return g.select(
        c, "n", (F.col("n") * 100.0 / F.sum("n").over(w)).alias("pct"),
        (F.max("n").over(w) / F.min("n").over(w)).alias("imbalance"),
    )


def normalized_counts(df: DataFrame, c: str) -> DataFrame:
    """``value_counts(normalize=True)``."""
    g = df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
    return g.select(c, (F.col("n") / F.sum("n").over(Window.partitionBy())).alias("share"))


def rate_by_group(df: DataFrame, g: str, y: str, weight: str | None = None) -> DataFrame:
    """Mean of ``y`` and count per group, NULL group dropped."""
    yy = F.col(y).cast("double")
    rate = F.avg(yy) if weight is None else F.sum(yy * F.col(weight)) / F.sum(weight)
    return df.filter(F.col(g).isNotNull()).groupBy(g).agg(rate.alias("rate"), F.count(F.lit(1)).alias("n"))


def flag_lift(df: DataFrame, flag_col: str, y: str) -> DataFrame:
    """Rate of ``y`` without / with the flag and the lift."""
    yy = F.col(y).cast("double")
    return df.agg(
        F.avg(F.when(F.col(flag_col) == 0, yy)).alias("rate_no"),
        F.avg(F.when(F.col(flag_col) == 1, yy)).alias("rate_yes"),
    ).withColumn("lift", F.col("rate_yes") - F.col("rate_no"))


def rate_by_missing(df: DataFrame, c: str, y: str) -> DataFrame:
    """Outcome rate by whether ``c`` is missing."""
    return df.groupBy(F.col(c).isNull().alias("missing")).agg(
        F.avg(F.col(y).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def weighted_mean(df: DataFrame, y: str, w: str) -> DataFrame:
    """Unweighted and weighted mean of ``y``."""
    yy = F.col(y).cast("double")
    return df.agg(F.avg(yy).alias("rate"), (F.sum(yy * F.col(w)) / F.sum(w)).alias("weighted_rate"))


def threshold_sweep(df: DataFrame, rate: str, thresholds: Sequence[float], y: str | None = None) -> DataFrame:
    """Target rate, count and imbalance for many cut-offs in ONE scan."""
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        hit = F.col(rate) >= F.lit(float(t))
        aggs.append(F.count_if(hit).alias(f"met__{i}"))
        if y is not None:
            aggs.append(F.avg(flag(flag(hit) == F.col(y)).cast("double")).alias(f"agree__{i}"))
    row = df.agg(*aggs)
    fields = lambda i, t: [F.lit(float(t)).alias("threshold"), F.col(f"met__{i}").alias("n_met")] + (
        [F.col(f"agree__{i}").alias("agreement")] if y is not None else [])
    long = row.select("_n", F.inline(F.array(*[F.struct(*fields(i, t)) for i, t in enumerate(thresholds)])))
    r = F.col("n_met") / F.col("_n")
    out = long.select(
        "threshold", r.alias("rate"), "n_met",
        (F.greatest(r, 1 - r) / F.least(r, 1 - r)).alias("imbalance"),
        *(["agreement"] if y is not None else []),
    )
    return out


def corr_with(df: DataFrame, cols: Sequence[str], x: str) -> DataFrame:
    """Pearson correlation of each column with ``x``, pairwise complete."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(x).cast("double")).alias(f"r__{c}") for c in cols])
    return _unpivot_stats(row, cols, ["r"])


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long correlation matrix ``(a, b, r)`` from one Gram aggregate (E17); null where a pair has no correlation."""
    r = pair_correlations(df, cols)
    rows = [(a, b, 1.0 if i == j else None if np.isnan(r[i, j]) else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def offdiag_summary(corr_long: DataFrame) -> DataFrame:
    """Mean, mean |r|, share negative and the extreme pairs off the diagonal."""
    o = corr_long.filter(F.col("a") != F.col("b"))
    pair = F.concat_ws("|", "a", "b")
    return o.agg(
        F.avg("r").alias("mean_r"), F.avg(F.abs("r")).alias("mean_abs_r"),
        F.avg(flag(F.col("r") < 0).cast("double")).alias("share_negative"),
        F.min("r").alias("min_r"),
        F.min_by(pair, F.struct(F.col("r"), F.col("a"), F.col("b"))).alias("min_pair"),
        F.max("r").alias("max_r"),
        F.min_by(pair, F.struct(-F.col("r"), F.col("a"), F.col("b"))).alias("max_pair"),
    )

def top_pairs(corr_long: DataFrame, k: int = 8, absolute: bool = True) -> DataFrame:
    """Upper-triangle pairs ranked by |r|."""
    o = corr_long.filter(F.col("a") < F.col("b"))
    key = F.abs("r") if absolute else F.col("r")
    return o.select("a", "b", "r", key.alias("abs_r")).orderBy(F.col("abs_r").desc(), "a", "b").limit(k)


def crosstab(df: DataFrame, a: str, b: str, normalize: bool = False) -> DataFrame:
    """Long contingency table ``(a, b, n[, share])``; ``normalize`` divides by row totals."""
    g = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        g = g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))
    return g


def pivot_wide(long: DataFrame, index: str, column: str, value: str, levels: Sequence) -> DataFrame:
    """``pivot`` with an explicit level list, absent cells NULL."""
    return long.groupBy(index).pivot(column, list(levels)).agg(F.first(value))


def melt(df: DataFrame, ids: Sequence[str], cols: Sequence[str], var: str = "column", value: str = "value") -> DataFrame:
    """Transpose / unpivot."""
    return df.unpivot(list(ids), list(cols), var, value)


def median_by_group(df: DataFrame, g: str, cols: Sequence[str]) -> DataFrame:
    """Exact median of many columns per group, long ``(g, column, median)``."""
    q = exact_quantiles(df.filter(F.col(g).isNotNull()), cols, [0.5], [g])
    return q.select(g, "column", F.col("q").alias("median"))


def segment_profile(df: DataFrame, seg: str, income: str, size: str, y: str, rate: str) -> DataFrame:
    """n, median income, median size, outcome rate, median residual rate, percent."""
    d = df.filter(F.col(seg).isNotNull())
    base = d.groupBy(seg).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("rate"))
    med = quantile_wide(d, [income, size, rate], [0.5], [seg], names=["m"])
    medw = med.groupBy(seg).agg(
        F.max(F.when(F.col("column") == income, F.col("m"))).alias("median_income"),
        F.max(F.when(F.col("column") == size, F.col("m"))).alias("median_size"),
        F.max(F.when(F.col("column") == rate, F.col("m"))).alias("median_rate"),
    )
    out = base.join(medw, seg, "left")
    return out.select(seg, "n", "median_income", "median_size", "rate", "median_rate",
                      (F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy())).alias("pct"))


def mean_by_segment(df: DataFrame, seg: str, cols: Sequence[str]) -> DataFrame:
    """Mean of many columns per segment, long ``(seg, column, mean)``."""
    g = df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(*[F.avg(F.col(c).cast("double")).alias(f"m__{c}") for c in cols])
    return g.select(seg, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m__{c}").alias("mean")) for c in cols])))


def zero_rate_by_segment(df: DataFrame, seg: str, cols: Sequence[str]) -> DataFrame:
    """Zero rate per segment and column, plus the 0/1 signature string per segment."""
    g = df.filter(F.col(seg).isNotNull()).groupBy(seg).agg(*[rate_if(F.col(c) == 0).alias(f"z__{c}") for c in cols])
    sig = F.concat_ws("", *[F.round(F.col(f"z__{c}"), 0).cast("int").cast("string") for c in cols])
    return g.select(seg, sig.alias("signature"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"z__{c}").alias("zero_rate")) for c in cols])))


def stratified_spread(df: DataFrame, stratum: str, seg: str, y: str) -> DataFrame:
    """Rate spread across segments raw and within strata, and their ratio."""
    yy = F.col(y).cast("double")
    d = df.filter(F.col(seg).isNotNull())
    within = d.groupBy(stratum, seg).agg(F.avg(yy).alias("rate")).select(F.lit(1).alias("w"), stratum, "rate")
    raw = d.groupBy(seg).agg(F.avg(yy).alias("rate")).select(F.lit(0).alias("w"), F.lit(None).alias(stratum), "rate")
    spreads = within.unionByName(raw).groupBy("w", stratum).agg((F.max("rate") - F.min("rate")).alias("s"))
    out = spreads.agg(
        F.max(F.when(F.col("w") == 0, F.col("s"))).alias("spread_raw"),
        F.avg(F.when(F.col("w") == 1, F.col("s"))).alias("spread_within"),
    )
    return out.withColumn("surviving", F.try_divide(F.col("spread_within"), F.col("spread_raw")))

def decile_table(df: DataFrame, decile: str, y: str, income: str, at_risk: bool = True) -> DataFrame:
    """Per decile: (at-risk) rate, median income, n."""
    yy = F.col(y).cast("double")
    base = df.groupBy(decile).agg(((1 - F.avg(yy)) if at_risk else F.avg(yy)).alias("rate"), F.count(F.lit(1)).alias("n"))
    med = exact_quantiles(df, [income], [0.5], [decile]).select(decile, F.col("q").alias("median_income"))
    return base.join(med, decile, "left").select(decile, "rate", "median_income", "n")


def histogram(df: DataFrame, c: str, bins: int = 60) -> DataFrame:
    """Equal-width histogram over [min, max], last bin closed."""
    x = F.col(c).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, n long")
    width = (hi - lo) / bins if hi > lo else 1.0
    b = F.least(F.floor((x - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1))
    g = df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def box_stats(df: DataFrame, g: str, c: str) -> DataFrame:
    """Quartiles and whiskers (most extreme points within 1.5 IQR) per group."""
    d = df.filter(F.col(g).isNotNull() & F.col(c).isNotNull())
    q = quantile_wide(d, [c], [0.25, 0.5, 0.75], [g], names=["q1", "median", "q3"]).drop("column")
    j = d.join(q, g)
    iqr = F.col("q3") - F.col("q1")
    inside = (F.col(c) >= F.col("q1") - 1.5 * iqr) & (F.col(c) <= F.col("q3") + 1.5 * iqr)
    return j.groupBy(g, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col(c))).alias("whisker_lo"), F.max(F.when(inside, F.col(c))).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"))


def argextreme(df: DataFrame, metric: str, key: str) -> DataFrame:
    """Key of the smallest and largest ``metric`` (first key on ties)."""
    m = F.col(metric)
    return df.filter(m.isNotNull()).agg(
        F.min_by(F.col(key), F.struct(m, F.col(key))).alias("argmin"), F.min(m).alias("min"),
        F.min_by(F.col(key), F.struct(-m, F.col(key))).alias("argmax"), F.max(m).alias("max"))


def best_per_group(df: DataFrame, g: str, metric: str, tiebreak: str) -> DataFrame:
    """Row with the largest metric per group, smallest tie-break first.

    A ``min_by`` aggregate rather than a window: partial aggregation keeps one
    candidate per group per task, so a group holding a third of all rows is
    never sorted in one task.
    """
    others = [c for c in df.columns if c != g]
    best = F.min_by(F.struct(*[F.col(c) for c in others]), F.struct(-F.col(metric), F.col(tiebreak)))
    return df.filter(F.col(metric).isNotNull()).groupBy(g).agg(best.alias("_b")).select(g, "_b.*")


def spread_of_means(df: DataFrame, param: str, metric: str) -> DataFrame:
    """Sample std across levels of ``param`` of the mean metric."""
    return df.groupBy(param).agg(F.avg(metric).alias("m")).agg(F.stddev_samp("m").alias("sensitivity"))
