"""A deterministic stand-in score so metric and targeting operators get exact SQL oracles.

p = logistic(3 (log income - 14.6) + 2 (groceries share - 0.25)), rounded to 3 places on
purpose so that tied scores exercise the tie rules. The trained-model score
(P12) runs the same operators without an oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import SEED
from ..operators.binning import with_quantile_bins
from ..operators.splits import random_score_col, stratified_folds
from .sqlviews import D

# fixed values: stand-in score coefficients
CENTER, SLOPE, G_CENTER, G_SLOPE = 14.6, 3.0, 0.25, 2.0


def score_col():
    z = F.lit(SLOPE) * (F.col("log_income") - F.lit(CENTER)) + F.lit(G_SLOPE) * (F.col("groceries_share") - F.lit(G_CENTER))
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 3)


def scored(units: DataFrame, decile: bool = False, fold: bool = False) -> DataFrame:
    """unit_id, y (target), at_risk, p, risk_score, pred, income, area, occupation, random_score, rate; on demand
    the income decile and the stratified fold, which cost a quantile fit and a ranking.
    """
    d = units.select(
        "unit_id", F.col("target").alias("y"), (1 - F.col("target")).alias("at_risk"), score_col().alias("p"),
        "income", "area", "occupation", "rate", "groceries_share", "log_income",
    ).withColumn("risk_score", 1 - F.col("p")).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    d = d.withColumn("random_score", random_score_col("unit_id", SEED))
    if decile:
        d = with_quantile_bins(d, "income", 10, "decile")
    return stratified_folds(d, "unit_id", "y", seed=SEED) if fold else d


SCORE_SQL = f"""sc0 AS (
  SELECT unit_id, target AS y, 1 - target AS at_risk,
    round(1 / (1 + exp(-({D(SLOPE)} * (log_income - {D(CENTER)}) + {D(G_SLOPE)} * (groceries_share - {D(G_CENTER)})))), 3) AS p,
    income, area, occupation, rate, groceries_share, log_income
  FROM units
),
dec_edges AS (SELECT quantile_cont(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM units),
sc AS (
  SELECT s.*, 1 - p AS risk_score, CAST(p > 0.5 AS INTEGER) AS pred,
    CAST(('0x' || substr(md5(CAST(unit_id AS VARCHAR) || '{SEED}'), 1, 13)) AS BIGINT) / {D(2 ** 52)} AS random_score,
    CAST((SELECT count(*) FROM unnest(e) t(x) WHERE s.income > x) AS INTEGER) AS decile,
    CAST((row_number() OVER (PARTITION BY y ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}')) - 1) % 5 AS INTEGER) AS fold
  FROM sc0 s, dec_edges
)"""
