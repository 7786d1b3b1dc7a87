"""Targeting and metric queries on the trained score (P1-P4, K5-K11): out-of-fold probabilities of the tuned boosted trees.

The same operators run on the stand-in score with SQL oracles (``q_metrics``); a trained model has none, so these are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CALIBRATION_BINS, CONTACT_BUDGETS, CURVE_POINTS, SEED, TARGET_RECALLS
from ..operators import binning as BN
from ..operators import metrics as M
from ..operators import targeting as T
from ..operators.splits import random_score_col
from .common import rounded
from .q_metrics import _long
from .q_models import oof_scores
from .registry import memo_result, register
from .tables import units_table


@memo_result
def trained_scores(spark, sf):
    """Every unit with its out-of-fold score, in the shape of the stand-in score (as a reliable checkpoint)."""
    oof = oof_scores(spark, sf).select("unit_id", "p")
    u = units_table(spark, sf).select("unit_id", F.col("target").alias("y"), (1 - F.col("target")).alias("at_risk"), "income", "area", "occupation", "rate")
    d = u.join(oof, "unit_id").withColumn("risk_score", 1 - F.col("p")).withColumn("pred", (F.col("p") > 0.5).cast("int"))
    return BN.with_quantile_bins(d.withColumn("random_score", random_score_col("unit_id", SEED)), "income", 10, "decile")


def _capture(spark, sf, budgets):
    return T.capture_table(_long(trained_scores(spark, sf)), "strategy", "score", "unit_id", "at_risk", budgets)


@register("p01_trained_capture")
def p01_trained_capture(spark, sf):
    return rounded(_capture(spark, sf, CONTACT_BUDGETS))


@register("p02_trained_lift_and_gain")
def p02_trained_lift_and_gain(spark, sf):
    of = {s: F.max(F.when(F.col("strategy") == s, F.col("captured"))) for s in ("model", "random", "income_rule")}
    w = _capture(spark, sf, CONTACT_BUDGETS).groupBy("fraction").agg(*[v.alias(s) for s, v in of.items()])
    return rounded(w.select("fraction", (F.col("model") / F.col("random")).alias("lift_over_random"), ((F.col("model") - F.col("income_rule")) * 100).alias("gain_over_rule_pp")))


@register("p03_trained_capture_curve")
def p03_trained_capture_curve(spark, sf):
    return rounded(_capture(spark, sf, BN.linspace(0.01, 1.0, CURVE_POINTS)))


@register("p04_trained_risk_by_area")
def p04_trained_risk_by_area(spark, sf):
    """Mean predicted risk beside the observed one, and each area's share of all predicted risk."""
    s = trained_scores(spark, sf).where("area IS NOT NULL")
    g = s.groupBy("area").agg(F.count(F.lit(1)).alias("n"), F.avg("risk_score").alias("predicted"), F.avg("at_risk").alias("observed"), F.sum("risk_score").alias("total"))
    all_risk = s.agg(F.sum("risk_score").alias("whole"))
    return rounded(g.crossJoin(F.broadcast(all_risk)).select("area", "n", "predicted", "observed", (F.col("total") / F.col("whole")).alias("share_of_risk")))  # one row


@register("k05_trained_auc")
def k05_trained_auc(spark, sf):
    return rounded(M.roc_auc(trained_scores(spark, sf), "y", "p"))


@register("k06_trained_pr_curve")
def k06_trained_pr_curve(spark, sf):
    return rounded(M.pr_curve(trained_scores(spark, sf), "y", "p"))


@register("k07_trained_best_f1")
def k07_trained_best_f1(spark, sf):
    return rounded(M.best_f1(M.pr_curve(trained_scores(spark, sf), "y", "p")))


@register("k08_trained_operating_points")
def k08_trained_operating_points(spark, sf):
    return rounded(M.operating_points(M.pr_curve(trained_scores(spark, sf), "y", "p"), TARGET_RECALLS))


@register("k10_trained_calibration")
def k10_trained_calibration(spark, sf):
    return rounded(M.calibration(trained_scores(spark, sf), "p", "y", CALIBRATION_BINS))


@register("k11_trained_accuracy_by_decile")
def k11_trained_accuracy_by_decile(spark, sf):
    return rounded(M.accuracy_by_slice(trained_scores(spark, sf), "p", "y", "decile"))


@register("k11_trained_accuracy_by_area")
def k11_trained_accuracy_by_area(spark, sf):
    return rounded(M.accuracy_by_slice(trained_scores(spark, sf), "p", "y", "area"))
