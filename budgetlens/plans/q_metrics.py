"""Queries for splits, baselines, metrics and targeting over the stand-in score."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (ALT_THRESHOLDS, CALIBRATION_BINS, CONTACT_BUDGETS, CURVE_POINTS, GAP_PCTS,
                         IMPLAUSIBLE_RATE, PEER_SCALE, SEED, TARGET_RECALLS, TARGET_THRESHOLD)
from ..operators import baselines as BL
from ..operators import binning as BN
from ..operators import metrics as M
from ..operators import profile as P
from ..operators import splits as SP
from ..operators import targeting as T
from ..spec import SHARES
from .common import rounded, rsql, union_sql
from .registry import register
from .scores import SCORE_SQL, scored
from .sqlviews import D, nz, with_units
from .tables import units_table


def S(spark, sf, **needs):
    return scored(units_table(spark, sf), **needs)


def W(body):
    return with_units(body, SCORE_SQL)


# ---- J8-J11: splits ---------------------------------------------------------------------------------
@register("j08_stratified_folds", sql=W("SELECT unit_id, fold FROM sc"))
def j08_stratified_folds(spark, sf):
    return S(spark, sf, fold=True).select("unit_id", "fold")


@register("j08_fold_balance", sql=W("SELECT y, fold, count(*) AS n FROM sc GROUP BY y, fold"))
def j08_fold_balance(spark, sf):
    return S(spark, sf, fold=True).groupBy("y", "fold").agg(F.count(F.lit(1)).alias("n"))


@register("j09_holdout", sql=W(f"""
    SELECT unit_id, CAST(row_number() OVER (PARTITION BY target ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}'))
      <= ceil(count(*) OVER (PARTITION BY target) * {D(0.2)}) AS INTEGER) AS is_test FROM units"""))
def j09_holdout(spark, sf):
    return SP.stratified_holdout(units_table(spark, sf).select("unit_id", "target"), "unit_id", "target").select("unit_id", "is_test")


@register("j10_class_weights", sql=W(rsql(
    "SELECT target, count(*) AS n, sum(count(*)) OVER () / (2.0 * count(*)) AS class_weight FROM units GROUP BY target",
    r6="class_weight")))
def j10_class_weights(spark, sf):
    w = SP.class_weights(units_table(spark, sf).select("unit_id", "target"), "target")
    return rounded(w.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.first("class_weight").alias("class_weight")))


@register("j11_disjoint_parts", sql=W(f"SELECT unit_id, CAST(ntile(5) OVER (ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}')) AS INTEGER) AS part FROM units"))
def j11_disjoint_parts(spark, sf):
    return SP.disjoint_parts(units_table(spark, sf).select("unit_id"), "unit_id", 5)


# ---- L1-L3: baselines ----------------------------------------------------------------------------------
@register("l01_majority_baseline", sql=W(rsql("""
    WITH m AS (SELECT fold, (SELECT CASE WHEN avg(y) > 0.5 THEN 1 ELSE 0 END FROM sc t WHERE t.fold <> f.fold) AS mode,
                      (SELECT avg(y) FROM sc t WHERE t.fold <> f.fold) AS prior FROM (SELECT DISTINCT fold FROM sc) f)
    SELECT sc.fold, avg(CASE WHEN m.mode = y THEN 1.0 ELSE 0.0 END) AS accuracy, avg(m.prior) AS prior
    FROM sc JOIN m ON sc.fold = m.fold GROUP BY sc.fold""", r6="accuracy prior")))
def l01_majority_baseline(spark, sf):
    return rounded(BL.majority_baseline(S(spark, sf, fold=True), "y", "fold"))


@register("l02_stratified_random", sql=W(rsql("""
    WITH pr AS (SELECT f.fold, (SELECT avg(y) FROM sc t WHERE t.fold <> f.fold) AS prior FROM (SELECT DISTINCT fold FROM sc) f)
    SELECT sc.fold, avg(CASE WHEN (CASE WHEN random_score < prior THEN 1 ELSE 0 END) = y THEN 1.0 ELSE 0.0 END) AS accuracy
    FROM sc JOIN pr ON sc.fold = pr.fold GROUP BY sc.fold""", r6="accuracy")))
def l02_stratified_random(spark, sf):
    return rounded(BL.stratified_random_baseline(S(spark, sf, fold=True), "y", "fold", "random_score"))


@register("l03_gini_stump", sql=W(rsql("""
    WITH v AS (SELECT log_income AS x, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS q FROM sc GROUP BY log_income),
    c AS (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(p) OVER (ORDER BY x) AS lp, sum(q) OVER (ORDER BY x) AS lq,
                 sum(p) OVER () AS tp, sum(q) OVER () AS tq FROM v),
    s AS (SELECT (x + nx) / 2 AS threshold, lp, lq, tp - lp AS rp, tq - lq AS rq FROM c WHERE nx IS NOT NULL),
    g AS (SELECT threshold,
       ((lp + lq) * (1 - (lp * lp + lq * lq) / ((lp + lq) * (lp + lq))) + (rp + rq) * (1 - (rp * rp + rq * rq) / ((rp + rq) * (rp + rq)))) AS imp,
       (rp + rq) / (lp + lq + rp + rq) AS share_above FROM s)
    SELECT threshold, share_above FROM g ORDER BY imp, threshold LIMIT 1""", r6="threshold share_above")))
def l03_gini_stump(spark, sf):
    return rounded(BL.gini_stump(S(spark, sf), "log_income", "y").select("threshold", "share_above"))


# ---- K1-K4: classification metrics ------------------------------------------------------------------------
_CM = """count(*) FILTER (WHERE y = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE y = 0 AND pred = 1) AS fp,
         count(*) FILTER (WHERE y = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE y = 1 AND pred = 1) AS tp"""


@register("k01_confusion", sql=W(f"SELECT {_CM} FROM sc"))
def k01_confusion(spark, sf):
    return M.confusion(S(spark, sf), "y", "pred")


def _metrics_sql(src="sc", group=""):
    g = f"{group}, " if group else ""
    return f"""SELECT {g}(tp + tn) * 1.0 / (tp + tn + fp + fn) AS accuracy,
      coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS precision, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS recall,
      (coalesce(2.0 * (tp * 1.0 / nullif(tp + fp, 0)) * (tp * 1.0 / nullif(tp + fn, 0)) / nullif(tp * 1.0 / nullif(tp + fp, 0) + tp * 1.0 / nullif(tp + fn, 0), 0), 0)
      + coalesce(2.0 * (tn * 1.0 / nullif(tn + fn, 0)) * (tn * 1.0 / nullif(tn + fp, 0)) / nullif(tn * 1.0 / nullif(tn + fn, 0) + tn * 1.0 / nullif(tn + fp, 0), 0), 0)) / 2 AS f1_macro
    FROM (SELECT {g}{_CM} FROM {src} {'GROUP BY ' + group if group else ''}) c"""


@register("k02_classification_metrics", sql=W(rsql(_metrics_sql(), r6="accuracy precision recall f1_macro")))
def k02_classification_metrics(spark, sf):
    return rounded(M.classification_metrics(S(spark, sf), "y", "pred"))


@register("k04_classification_report", sql=W(rsql(f"""
    WITH c AS (SELECT {_CM} FROM sc),
    r AS (SELECT *, coalesce(tp * 1.0 / nullif(tp + fp, 0), 0) AS p1, coalesce(tp * 1.0 / nullif(tp + fn, 0), 0) AS r1,
                 coalesce(tn * 1.0 / nullif(tn + fn, 0), 0) AS p0, coalesce(tn * 1.0 / nullif(tn + fp, 0), 0) AS r0,
                 CAST(tp + fn AS DOUBLE) AS s1, CAST(tn + fp AS DOUBLE) AS s0 FROM c),
    f AS (SELECT *, coalesce(2 * p1 * r1 / nullif(p1 + r1, 0), 0) AS f1, coalesce(2 * p0 * r0 / nullif(p0 + r0, 0), 0) AS f0 FROM r)
    SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
    UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
    UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM f
    UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1), (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM f""",
    r6="precision recall f1 support")))
def k04_classification_report(spark, sf):
    return rounded(M.classification_report(S(spark, sf), "y", "pred"))


# ---- K5: ROC-AUC ---------------------------------------------------------------------------------------------
_AUC = """SELECT {g}(sum(r) FILTER (WHERE y = 1) - n1 * (n1 + 1) / 2.0::DOUBLE) / (n1 * n0) AS roc_auc FROM (
      SELECT {g}y, rank() OVER (PARTITION BY {pg} ORDER BY {s}) + (count(*) OVER (PARTITION BY {pg}, {s}) - 1) / 2.0::DOUBLE AS r,
        CAST(count(*) FILTER (WHERE y = 1) OVER (PARTITION BY {pg}) AS DOUBLE) AS n1,
        CAST(count(*) FILTER (WHERE y = 0) OVER (PARTITION BY {pg}) AS DOUBLE) AS n0
      FROM sc {w}) t GROUP BY {g}n1, n0"""


@register("k05_roc_auc", sql=W(rsql(_AUC.format(g="", pg="1", s="p", w=""), r6="roc_auc")))
def k05_roc_auc(spark, sf):
    return rounded(M.roc_auc(S(spark, sf), "y", "p"))


@register("k05_roc_auc_by_area", sql=W(rsql(_AUC.format(g="area, ", pg="area", s="p", w="WHERE area IS NOT NULL"), r6="roc_auc")))
def k05_roc_auc_by_area(spark, sf):
    return rounded(M.roc_auc(S(spark, sf).filter(F.col("area").isNotNull()), "y", "p", ["area"]))


@register("h08_auc_score_vs_flag", sql=with_units(rsql(_AUC.format(g="", pg="1", s="p", w="").replace(
    "FROM sc", "FROM (SELECT has_flag AS y, round(1 / (1 + exp(-(" + D(3.0) + " * (log_income - " + D(14.6) + ") + " + D(2.0)
    + " * (groceries_share - " + D(0.25) + ")))), 3) AS p FROM units) sc"), r6="roc_auc")))
def h08_auc_score_vs_flag(spark, sf):
    from .scores import score_col

    u = units_table(spark, sf).select(F.col("has_flag").alias("y"), score_col().alias("p"))
    return rounded(M.roc_auc(u, "y", "p"))


# ---- K6-K8: precision-recall for the at-risk class ------------------------------------------------------------------
_PR = """pr0 AS (SELECT risk_score AS s, count(*) FILTER (WHERE at_risk = 1) AS pos, count(*) FILTER (WHERE at_risk = 0) AS neg FROM sc GROUP BY risk_score),
pr1 AS (SELECT s, pos, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS P FROM pr0),
curve AS (SELECT s AS threshold, tp * 1.0 / (tp + fp) AS precision, tp * 1.0 / P AS recall FROM pr1 WHERE tp - pos < P
          UNION ALL SELECT NULL, 1.0, 0.0)"""


@register("k06_pr_curve", sql=with_units(rsql("SELECT threshold, precision, recall FROM curve", r6="threshold precision recall"),
                                         SCORE_SQL + ",\n" + _PR))
def k06_pr_curve(spark, sf):
    return rounded(M.pr_curve(S(spark, sf), "at_risk", "risk_score"))


@register("k07_best_f1", sql=with_units(rsql(
    """SELECT threshold, precision, recall, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM curve
       WHERE threshold IS NOT NULL ORDER BY f1 DESC, threshold LIMIT 1""", r6="threshold precision recall f1"), SCORE_SQL + ",\n" + _PR))
def k07_best_f1(spark, sf):
    return rounded(M.best_f1(M.pr_curve(S(spark, sf), "at_risk", "risk_score")))


@register("k08_operating_points", sql=with_units(rsql(union_sql(TARGET_RECALLS, (
    "SELECT * FROM (SELECT {c!r}::DOUBLE AS target_recall, threshold, precision, recall FROM curve "
    "ORDER BY abs(recall - {c!r}::DOUBLE), coalesce(threshold, 'inf'::DOUBLE) LIMIT 1)")), r6="target_recall threshold precision recall"),
    SCORE_SQL + ",\n" + _PR))
def k08_operating_points(spark, sf):
    return rounded(M.operating_points(M.pr_curve(S(spark, sf), "at_risk", "risk_score"), TARGET_RECALLS))


# ---- K9: fold mean and sd ----------------------------------------------------------------------------------------
@register("k09_fold_summary", sql=W(rsql(
    f"SELECT avg(accuracy) AS accuracy_mean, avg(f1_macro) AS f1_macro_mean, stddev_pop(accuracy) AS accuracy_sd, "
    f"stddev_pop(f1_macro) AS f1_macro_sd FROM ({_metrics_sql(group='fold')}) m",
    r6="accuracy_mean f1_macro_mean accuracy_sd f1_macro_sd")))
def k09_fold_summary(spark, sf):
    s = S(spark, sf, fold=True)
    return rounded(M.fold_summary(M.classification_metrics(s, "y", "pred", ["fold"]), ["accuracy", "f1_macro"]))


# ---- K10 / K11: calibration and reliability by slice ------------------------------------------------------------------
_CAL_EDGES = BN.linspace(0.0, 1.0, CALIBRATION_BINS + 1)


@register("k10_calibration", sql=W(rsql(
    "SELECT bin, avg(p) AS predicted, avg(y) AS actual, count(*) AS n, avg(y) - avg(p) AS error FROM (SELECT p, y, CAST(CASE WHEN p > 0 AND p <= 1.0 THEN "
    + " + ".join(f"(CASE WHEN p > {D(e)} THEN 1 ELSE 0 END)" for e in _CAL_EDGES[1:-1]) + " END AS INTEGER) AS bin FROM sc) b "
    "WHERE bin IS NOT NULL GROUP BY bin", r6="predicted actual error")))
def k10_calibration(spark, sf):
    return rounded(M.calibration(S(spark, sf), "p", "y", CALIBRATION_BINS))


@register("k11_accuracy_by_decile", sql=W(rsql(
    "SELECT decile, avg(CASE WHEN CAST(p > 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM sc GROUP BY decile",
    r6="accuracy")))
def k11_accuracy_by_decile(spark, sf):
    return rounded(M.accuracy_by_slice(S(spark, sf, decile=True), "p", "y", "decile"))


@register("k11_accuracy_by_area", sql=W(rsql(
    "SELECT area, avg(CASE WHEN CAST(p > 0.5 AS INTEGER) = y THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n FROM sc WHERE area IS NOT NULL GROUP BY area",
    r6="accuracy")))
def k11_accuracy_by_area(spark, sf):
    return rounded(M.accuracy_by_slice(S(spark, sf), "p", "y", "area"))


# ---- P1 / P3: capture by contact budget ------------------------------------------------------------------------------------
def _long(s):
    """One row for each strategy and unit, from one pass over the units."""
    strategies = (("model", F.col("risk_score")), ("income_rule", -F.col("income")), ("random", F.col("random_score")))
    each = F.array(*[F.struct(F.lit(n).alias("strategy"), c.cast("double").alias("score")) for n, c in strategies])
    return s.select(F.inline(each), "unit_id", "at_risk")


def _capture_sql(fractions):
    vals = ", ".join(f"({D(f)})" for f in fractions)
    return f"""WITH lg AS (SELECT 'model' AS strategy, unit_id, risk_score AS score, at_risk FROM sc
                UNION ALL SELECT 'income_rule', unit_id, -income, at_risk FROM sc
                UNION ALL SELECT 'random', unit_id, random_score, at_risk FROM sc),
    rk AS (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY score DESC, unit_id) AS rn,
                  count(*) OVER (PARTITION BY strategy) AS n, sum(at_risk) OVER (PARTITION BY strategy) AS npos FROM lg),
    b AS (SELECT * FROM (VALUES {vals}) b(fraction))
    SELECT strategy, fraction, CAST(floor(n * fraction) AS BIGINT) AS k,
      CAST(coalesce(sum(at_risk) FILTER (WHERE rn <= floor(n * fraction)), 0) AS BIGINT) AS hits,
      coalesce(sum(at_risk) FILTER (WHERE rn <= floor(n * fraction)), 0) * 1.0 / npos AS captured,
      coalesce(sum(at_risk) FILTER (WHERE rn <= floor(n * fraction)), 0) * 1.0 / nullif(floor(n * fraction), 0) AS precision
    FROM rk, b GROUP BY strategy, fraction, n, npos"""


@register("p01_capture_table", sql=W(rsql(_capture_sql(CONTACT_BUDGETS), r6="fraction captured precision")))
def p01_capture_table(spark, sf):
    return rounded(T.capture_table(_long(S(spark, sf)), "strategy", "score", "unit_id", "at_risk", CONTACT_BUDGETS))


_CURVE = BN.linspace(0.01, 1.0, CURVE_POINTS)


@register("p03_capture_curve", sql=W(rsql(_capture_sql(_CURVE), r6="fraction captured precision")))
def p03_capture_curve(spark, sf):
    return rounded(T.capture_table(_long(S(spark, sf)), "strategy", "score", "unit_id", "at_risk", _CURVE))


# ---- P4: concentration ----------------------------------------------------------------------------------------------------
@register("p04_concentration_area", sql=W(rsql(
    """SELECT area, count(*) AS n, 1 - avg(y) AS at_risk_rate, count(*) FILTER (WHERE y = 0) * 1.0 / sum(count(*) FILTER (WHERE y = 0)) OVER () AS share_of_at_risk
       FROM sc WHERE area IS NOT NULL GROUP BY area""", r6="at_risk_rate share_of_at_risk")))
def p04_concentration_area(spark, sf):
    return rounded(T.concentration(S(spark, sf), "area", "y"))


@register("p04_concentration_occupation", sql=W(rsql(
    """SELECT occupation, count(*) AS n, 1 - avg(y) AS at_risk_rate, count(*) FILTER (WHERE y = 0) * 1.0 / sum(count(*) FILTER (WHERE y = 0)) OVER () AS share_of_at_risk
       FROM sc WHERE occupation IS NOT NULL GROUP BY occupation""", r6="at_risk_rate share_of_at_risk")))
def p04_concentration_occupation(spark, sf):
    return rounded(T.concentration(S(spark, sf), "occupation", "y"))


# ---- P5-P9: peer benchmark, excess, gap, closable -------------------------------------------------------------------------
def _with_decile(spark, sf):
    return BN.with_quantile_bins(units_table(spark, sf), "income", 10, "decile")


_DEC_UNITS = """dec_edges2 AS (SELECT quantile_cont(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM units),
ud AS (SELECT u.*, CAST((SELECT count(*) FROM unnest(e) t(x) WHERE u.income > x) AS INTEGER) AS decile FROM units u, dec_edges2),
bench AS (SELECT decile, """ + ", ".join(f"quantile_cont({s}, 0.5) AS bench_{s}" for s in SHARES) + """ FROM ud WHERE target = 1 GROUP BY decile),
ex AS (SELECT ud.unit_id, ud.decile, ud.income, ud.rate, """ + ", ".join(
    f"{s} - bench_{s} AS ex_{s}, ({s} - bench_{s}) * (income * (1 - rate)) AS money_{s}" for s in SHARES) + """
       FROM ud LEFT JOIN bench ON ud.decile = bench.decile WHERE ud.target = 0)"""


@register("p05_peer_benchmark", sql=with_units(rsql("SELECT * FROM bench", r6=[f"bench_{s}" for s in SHARES]), _DEC_UNITS))
def p05_peer_benchmark(spark, sf):
    return rounded(T.peer_benchmark(_with_decile(spark, sf), "decile", "target", SHARES))


def _excess(spark, sf):
    u = _with_decile(spark, sf)
    bench = T.peer_benchmark(u, "decile", "target", SHARES)
    return T.peer_excess(u, bench, "decile", "target", SHARES, "income", "rate", "unit_id")


@register("p06_peer_excess", sql=with_units(rsql("SELECT * FROM ex", r6=[f"ex_{s}" for s in SHARES] + ["rate"],
                                                 r2=[f"money_{s}" for s in SHARES] + ["income"]), _DEC_UNITS))
def p06_peer_excess(spark, sf):
    return rounded(_excess(spark, sf), money=[f"money_{s}" for s in SHARES])


_LONGX = union_sql(SHARES, "SELECT '{c}' AS part0, ex_{c} AS ex, money_{c} AS money FROM ex")


@register("p07_category_excess", sql=with_units(rsql(f"""
    SELECT replace(part0, '_share', '') AS part, quantile_cont(ex, 0.5) * 100 AS median_excess_pp,
      avg(CASE WHEN ex > 0 THEN 1.0 ELSE 0.0 END) AS share_above_peer, sum(greatest(money, 0)) / {D(PEER_SCALE)} AS aggregate_excess
    FROM ({_LONGX}) l GROUP BY part0""", r6="median_excess_pp share_above_peer aggregate_excess"), _DEC_UNITS))
def p07_category_excess(spark, sf):
    return rounded(T.category_excess(_excess(spark, sf), SHARES, PEER_SCALE))


_GAP = f"gp AS (SELECT *, ({D(TARGET_THRESHOLD)} - rate) * income AS gap, " + " + ".join(
    f"coalesce(greatest(money_{s}, 0), 0)" for s in SHARES) + " AS recoverable FROM ex)"


@register("p08_gap_distribution", sql=with_units(rsql(
    "SELECT count(gap) AS n, avg(gap) AS mean, stddev_samp(gap) AS std, min(gap) AS min, "
    + ", ".join(f"quantile_cont(gap, {D(p)}) AS p{round(p * 100):g}" for p in GAP_PCTS) + ", max(gap) AS max FROM gp",
    r2="mean std min p25 p50 p75 p90 max"), _DEC_UNITS + ",\n" + _GAP))
def p08_gap_distribution(spark, sf):
    g = T.gap_and_recoverable(_excess(spark, sf), SHARES, "income", "rate", TARGET_THRESHOLD)
    d = P.describe(g, ["gap"], GAP_PCTS).drop("column", "skew")
    return rounded(d, money=["mean", "std", "min", "p25", "p50", "p75", "p90", "max"])


@register("p09_closable", sql=with_units(rsql(
    "SELECT avg(CASE WHEN recoverable >= gap THEN 1.0 ELSE 0.0 END) AS closable, quantile_cont(gap, 0.5) AS median_gap, "
    "quantile_cont(recoverable, 0.5) AS median_recoverable FROM gp", r6="closable", r2="median_gap median_recoverable"),
    _DEC_UNITS + ",\n" + _GAP))
def p09_closable(spark, sf):
    g = T.gap_and_recoverable(_excess(spark, sf), SHARES, "income", "rate", TARGET_THRESHOLD)
    return rounded(T.closable_summary(g), money=["median_gap", "median_recoverable"])


@register("p10_measurement_caveat", sql=with_units(rsql(f"""
    SELECT count(*) FILTER (WHERE rate < {D(IMPLAUSIBLE_RATE)}) AS n_implausible,
      avg(CASE WHEN rate < {D(IMPLAUSIBLE_RATE)} THEN 1.0 ELSE 0.0 END) AS share_implausible,
      count(*) FILTER (WHERE rate < {D(IMPLAUSIBLE_RATE)} AND target = 0) * 1.0 / nullif(count(*) FILTER (WHERE rate < {D(IMPLAUSIBLE_RATE)}), 0) AS share_at_risk_among,
      count(*) FILTER (WHERE rate < {D(IMPLAUSIBLE_RATE)}) * 1.0 / nullif(count(*) FILTER (WHERE target = 0), 0) AS share_of_at_risk_group
    FROM units""", r6="share_implausible share_at_risk_among share_of_at_risk_group")))
def p10_measurement_caveat(spark, sf):
    return rounded(T.measurement_caveat(units_table(spark, sf), "rate", "target", IMPLAUSIBLE_RATE))


@register("e15_label_agreement", sql=with_units(rsql(union_sql(ALT_THRESHOLDS, (
    "SELECT {c!r}::DOUBLE AS threshold, avg(CASE WHEN rate >= {c!r}::DOUBLE THEN 0.0 ELSE 1.0 END) AS at_risk, "
    "avg(CASE WHEN (CASE WHEN rate >= {c!r}::DOUBLE THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS agreement FROM units")),
    r6="threshold at_risk agreement")))
def e15_label_agreement(spark, sf):
    s = P.threshold_sweep(units_table(spark, sf), "rate", ALT_THRESHOLDS, y="target")
    return rounded(s.select("threshold", (1 - F.col("rate")).alias("at_risk"), "agreement"))
