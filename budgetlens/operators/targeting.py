"""Targeting and peer benchmarking.

Top-fraction selection is exact and distributed: rows are aggregated to one row
per (strategy, distinct score), prefix sums give the rows and hits above each
score, and only the boundary score of each budget - the one that is cut in the
middle - is ranked by unit key (itself distributed, so a tied score shared by
a third of all units is still split across tasks).
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import count_if, flag, nz_sum, rate_if
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import prefix_sums


def top_fraction_hits(long: DataFrame, strategy: str, score: str, key: str, y: str,
                      fractions: Sequence[float]) -> DataFrame:
    """For each strategy and fraction: k = floor(n * f) top rows by score desc, key asc; hits among them (F8).

    ``long`` holds one row per (strategy, unit). Returns (strategy, fraction, k, hits).
    """
    n_by = {r[0]: r[1] for r in long.groupBy(strategy).agg(F.count(F.lit(1))).collect()}  # one row per strategy
    spark = long.sparkSession
    budgets = spark.createDataFrame(
        [(s, float(f), int(math.floor(n * f))) for s, n in n_by.items() for f in fractions],
        f"{strategy} string, fraction double, k long")
    agg = long.groupBy(strategy, score).agg(F.count(F.lit(1)).alias("cnt"), F.sum(F.col(y).cast("long")).alias("hit"))
    pre = prefix_sums(agg, [score], ["cnt", "hit"], part_cols=[strategy], descending=True)
    # boundary score per budget: rows before it < k <= rows through it
    bnd = pre.join(F.broadcast(budgets), strategy).filter(
        (F.col("cum_cnt") - F.col("cnt") < F.col("k")) & (F.col("k") <= F.col("cum_cnt"))
    ).select(strategy, "fraction", "k", F.col(score).alias("_bs"), (F.col("cum_cnt") - F.col("cnt")).alias("before"),
             (F.col("cum_hit") - F.col("hit")).alias("before_hit"), "cnt", "hit")
    full = bnd.filter(F.col("before") + F.col("cnt") == F.col("k")).select(
        strategy, "fraction", "k", (F.col("before_hit") + F.col("hit")).alias("hits"))
    partial = bnd.filter(F.col("before") + F.col("cnt") > F.col("k")).select(
        F.col(strategy).alias("_ps"), "fraction", "k", "_bs", "before", "before_hit")
    # rows of the partially taken score groups, ranked by key once for all budgets that end in the group
    tied = partial.select("_ps", "_bs").distinct()
    rows = long.join(F.broadcast(tied), (F.col(strategy) == F.col("_ps")) & (F.col(score) == F.col("_bs"))) \
        .select("_ps", "_bs", F.col(key), F.col(y).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"))
    ranked = prefix_sums(rows, [key], ["_one", "_y"], part_cols=["_ps", "_bs"])
    part_hits = ranked.join(F.broadcast(partial), ["_ps", "_bs"]).where(F.col("cum__one") == F.col("k") - F.col("before")).select(
        F.col("_ps").alias(strategy), "fraction", "k", (F.col("before_hit") + F.col("cum__y")).alias("hits"))
    zero = budgets.filter(F.col("k") == 0).select(strategy, "fraction", "k", F.lit(0).cast("long").alias("hits"))
    return full.unionByName(part_hits).unionByName(zero)


def capture_table(long: DataFrame, strategy: str, score: str, key: str, y: str,
                  fractions: Sequence[float]) -> DataFrame:
    """Capture (hits / all positives) and precision (hits / k) per strategy and budget."""
    hits = top_fraction_hits(long, strategy, score, key, y, fractions)
    pos = long.groupBy(strategy).agg(F.sum(F.col(y).cast("long")).alias("_p"))
    return hits.join(F.broadcast(pos), strategy).select(
        strategy, "fraction", "k", "hits", F.try_divide(F.col("hits"), F.col("_p")).alias("captured"),
        F.try_divide(F.col("hits"), F.col("k")).alias("precision"))


def concentration(df: DataFrame, g: str, y: str) -> DataFrame:
    """Per group: units, at-risk rate (y = 0) and share of all at-risk units."""
    yy = F.col(y)
    c = df.filter(F.col(g).isNotNull()).groupBy(g).agg(
        F.count(F.lit(1)).alias("n"), (1 - F.avg(yy.cast("double"))).alias("at_risk_rate"),
        count_if(yy == 0).alias("_r"))
    return c.select(g, "n", "at_risk_rate", (F.col("_r") / F.sum("_r").over(Window.partitionBy())).alias("share_of_at_risk"))


def peer_benchmark(df: DataFrame, decile: str, y: str, shares: Sequence[str]) -> DataFrame:
    """Median share of on-track units (y = 1) per decile, one column per share."""
    q = exact_quantiles(df.filter(F.col(y) == 1), shares, [0.5], [decile])
    return q.groupBy(decile).agg(*[F.max(F.when(F.col("column") == s, F.col("q"))).alias(f"bench_{s}") for s in shares])


def peer_excess(df: DataFrame, bench: DataFrame, decile: str, y: str, shares: Sequence[str],
                income: str, rate: str, key: str) -> DataFrame:
    """At-risk rows with excess share and excess money per part vs the decile benchmark.

    The benchmark has one row per decile (a fixed, tiny table) and is broadcast; a
    decile without an on-track peer gets NULL excess.
    """
    risk = df.filter(F.col(y) == 0).join(F.broadcast(bench), decile, "left")
    total_exp = F.col(income) * (1 - F.col(rate))
    cols = []
    for s in shares:
        ex = F.col(s) - F.col(f"bench_{s}")
        cols += [ex.alias(f"ex_{s}"), (ex * total_exp).alias(f"money_{s}")]
    return risk.select(key, decile, income, rate, *cols)


def category_excess(excess: DataFrame, shares: Sequence[str], scale: float = 1e7) -> DataFrame:
    """Per part: median excess (pp), share above peer, aggregate positive excess / scale."""
    longx = excess.select(F.inline(F.array(*[
        F.struct(F.lit(s.removesuffix("_share")).alias("part"), F.col(f"ex_{s}").alias("ex"), F.col(f"money_{s}").alias("money"))
        for s in shares])))
    base = longx.groupBy("part").agg(
        rate_if(F.col("ex") > 0).alias("share_above_peer"),
        (F.sum(F.greatest(F.col("money"), F.lit(0.0))) / F.lit(scale)).alias("aggregate_excess"))
    med = exact_quantiles(longx, ["ex"], [0.5], ["part"]).select("part", (F.col("q") * 100).alias("median_excess_pp"))
    return base.join(med, "part", "left").select("part", "median_excess_pp", "share_above_peer", "aggregate_excess")


def gap_and_recoverable(excess: DataFrame, shares: Sequence[str], income: str, rate: str,
                        target_rate: float) -> DataFrame:
    """Per at-risk unit: money gap to the target rate and recoverable excess."""
    rec = nz_sum([F.greatest(F.col(f"money_{s}"), F.lit(0.0)) for s in shares])
    return excess.select("*", ((F.lit(float(target_rate)) - F.col(rate)) * F.col(income)).alias("gap"), rec.alias("recoverable"))


def closable_summary(gaps: DataFrame) -> DataFrame:
    """Share of at-risk units whose recoverable excess covers the gap; median gap and recoverable."""
    base = gaps.agg(rate_if(F.col("recoverable") >= F.col("gap")).alias("closable"))
    med = exact_quantiles(gaps, ["gap", "recoverable"], [0.5]).groupBy().agg(
        F.max(F.when(F.col("column") == "gap", F.col("q"))).alias("median_gap"),
        F.max(F.when(F.col("column") == "recoverable", F.col("q"))).alias("median_recoverable"))
    stacked = base.unionByName(med, allowMissingColumns=True)
    return stacked.agg(*[F.max(c).alias(c) for c in ("closable", "median_gap", "median_recoverable")])


def measurement_caveat(df: DataFrame, rate: str, y: str, below: float) -> DataFrame:
    """Implausible rows (rate < below): count, share, share at risk, share of the at-risk group (P10)."""
    imp = F.coalesce(F.col(rate) < F.lit(float(below)), F.lit(False))
    return df.agg(
        F.count_if(imp).alias("n_implausible"), rate_if(imp).alias("share_implausible"),
        F.try_divide(F.count_if(imp & (F.col(y) == 0)), F.count_if(imp)).alias("share_at_risk_among"),
        F.try_divide(F.count_if(imp), F.count_if(F.col(y) == 0)).alias("share_of_at_risk_group"))
