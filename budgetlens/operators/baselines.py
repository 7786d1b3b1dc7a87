"""Floors every model must beat (L1-L3), as exact aggregations per fold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import flag
from ..functions.ranking import prefix_sums


def _train_counts(df: DataFrame, y: str, fold: str) -> DataFrame:
    """Per held-out fold: positives and rows of the OTHER folds (k rows)."""
    c = df.groupBy(fold).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("long")).alias("_p"))
    tot = c.agg(F.sum("_n").alias("_N"), F.sum("_p").alias("_P")).first()
    return c.select(fold, (F.lit(tot["_N"]) - F.col("_n")).alias("train_n"), (F.lit(tot["_P"]) - F.col("_p")).alias("train_pos"))


def majority_baseline(df: DataFrame, y: str, fold: str) -> DataFrame:
    """Most frequent training class (ties -> 0) and the prior, scored on each held-out fold (L1)."""
    tc = _train_counts(df, y, fold).select(
        fold, (F.col("train_pos") * 2 > F.col("train_n")).cast("int").alias("_mode"),
        (F.col("train_pos") / F.col("train_n")).alias("prior"))
    j = df.join(F.broadcast(tc), fold)  # k rows
    return j.groupBy(fold).agg(F.avg(flag(F.col("_mode") == F.col(y)).cast("double")).alias("accuracy"),
                               F.first("prior").alias("prior"))


def stratified_random_baseline(df: DataFrame, y: str, fold: str, uniform: str) -> DataFrame:
    """Predict 1 when a seeded uniform draw is below the training prior (L2)."""
    tc = _train_counts(df, y, fold).select(fold, (F.col("train_pos") / F.col("train_n")).alias("_prior"))
    j = df.join(F.broadcast(tc), fold)
    pred = (F.col(uniform) < F.col("_prior")).cast("int")
    return j.groupBy(fold).agg(F.avg(flag(pred == F.col(y)).cast("double")).alias("accuracy"))


def gini_stump(df: DataFrame, x: str, y: str) -> DataFrame:
    """Exact depth-1 Gini split on one feature: best threshold (midpoint) and share above (L3).

    Distinct values with class counts -> prefix sums -> weighted child impurity per
    split; the smallest threshold wins ties, as a left-to-right split search does.
    """
    d = df.filter(F.col(x).isNotNull())
    v = d.groupBy(x).agg(F.count_if(F.col(y) == 1).alias("p"), F.count_if(F.col(y) == 0).alias("q"))
    tot = v.agg(F.sum("p").alias("tp"), F.sum("q").alias("tq")).first()
    pre = prefix_sums(v, [x], ["p", "q"])
    lp, lq = F.col("cum_p").cast("double"), F.col("cum_q").cast("double")
    rp, rq = F.lit(float(tot["tp"])) - lp, F.lit(float(tot["tq"])) - lq
    imp = (lp + lq) * (1 - (lp * lp + lq * lq) / ((lp + lq) * (lp + lq))) + \
          (rp + rq) * (1 - (rp * rp + rq * rq) / ((rp + rq) * (rp + rq)))
    cand = pre.filter((rp + rq) > 0).select(F.col(x).alias("v"), imp.alias("imp"))
    best = cand.agg(F.min_by("v", F.struct("imp", "v")).alias("v")).first()["v"]
    nxt = d.filter(F.col(x) > F.lit(best)).agg(F.min(x)).first()[0]
    threshold = (best + nxt) / 2
    n = float(tot["tp"] + tot["tq"])
    return d.agg(F.lit(threshold).alias("threshold"),
                 (F.count_if(F.col(x) > F.lit(threshold)) / F.lit(n)).alias("share_above"))
