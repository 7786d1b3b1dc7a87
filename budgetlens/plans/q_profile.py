"""Queries for profiling and grouped statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import DESCRIBE_PCTS, HIST_BINS, ROW_SAMPLE, SEED, TAIL_PCTS, THRESHOLD_SWEEP
from ..operators import profile as P
from ..spec import PARTS, SHARES
from .common import rounded, rsql, union_sql
from .registry import register
from .sqlviews import D, with_units
from .tables import units_table

MONEY_COLS = ["income", "total", "residual", *PARTS]
NUMERIC = ["log_income", "size", "dependents", "debt_to_income"]


def U(spark, sf):
    return units_table(spark, sf)


# ---- E1 / E2: describe ---------------------------------------------------------
def _describe_sql(cols, pcts, src="units"):
    names = [f"p{round(p * 100, 4):g}".replace(".", "_") for p in pcts]
    qs = ", ".join(f"quantile_cont({{c}}, {D(p)}) AS {n}" for p, n in zip(pcts, names))
    body = union_sql(cols, (
        f"SELECT '{{c}}' AS column, count({{c}}) AS n, avg({{c}}) AS mean, stddev_samp({{c}}) AS std, "
        f"CAST(min({{c}}) AS DOUBLE) AS min, {qs}, CAST(max({{c}}) AS DOUBLE) AS max, skewness({{c}}) AS skew FROM {src}"
    ))
    return body, " ".join(["mean", "std", "min", *names, "max", "skew"])


_b, _r = _describe_sql(MONEY_COLS, [0.25, 0.5, 0.75])


@register("e01_describe_money", sql=with_units(rsql(_b, r6="skew std mean", r2="min p25 p50 p75 max")))
def e01_describe_money(spark, sf):
    d = P.describe(U(spark, sf), MONEY_COLS)
    return rounded(d, money=["min", "p25", "p50", "p75", "max"]).select(
        "column", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "p25", "p50",
        "p75", "max", "skew")


_b2, _r2 = _describe_sql(["rate"], DESCRIBE_PCTS)


@register("e02_describe_rate", sql=with_units(rsql(_b2, r6=_r2)))
def e02_describe_rate(spark, sf):
    return rounded(P.describe(U(spark, sf), ["rate"], DESCRIBE_PCTS))


_b3, _r3 = _describe_sql(["debt_to_income"], TAIL_PCTS)


@register("e02_describe_debt_tail", sql=with_units(rsql(_b3, r6=_r3)))
def e02_describe_debt_tail(spark, sf):
    return rounded(P.describe(U(spark, sf), ["debt_to_income"], TAIL_PCTS))


# ---- E3: scale table -------------------------------------------------------------
_e3_cols = [*SHARES, *NUMERIC]
_e3 = union_sql(_e3_cols, "SELECT '{c}' AS column, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max, "
                          "stddev_samp({c}) AS std, skewness({c}) AS skew, CAST(max({c}) - min({c}) AS DOUBLE) AS range FROM units")


@register("e03_scale_table", sql=with_units(rsql(
    f"SELECT *, max(std) OVER () / min(std) OVER () AS std_ratio FROM ({_e3}) s", r6="min max std skew range std_ratio")))
def e03_scale_table(spark, sf):
    return rounded(P.scale_table(U(spark, sf), _e3_cols))


# ---- E4: zero rates --------------------------------------------------------------
@register("e04_zero_rates", sql=with_units(rsql(union_sql(
    SHARES, "SELECT '{c}' AS column, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate FROM units"), r6="zero_rate")))
def e04_zero_rates(spark, sf):
    return rounded(P.zero_rates(U(spark, sf), SHARES))


# ---- E5: missing profile ----------------------------------------------------------
_all_unit_cols = ["unit_id", "weight", "income", "log_income", "size", "dependents", "occupation", "area", "segment",
                  "debt_to_income", *SHARES, "has_flag", *PARTS, "total", "residual", "rate", "target"]


@register("e05_missing_profile", sql=with_units(rsql(
    "SELECT \"column\", n_missing, n_missing * 100.0 / n AS pct FROM (" + union_sql(
        _all_unit_cols, "SELECT '{c}' AS column, count(*) FILTER (WHERE {c} IS NULL) AS n_missing, count(*) AS n FROM units")
    + ") m WHERE n_missing > 0", r6="pct")))
def e05_missing_profile(spark, sf):
    return rounded(P.missing_profile(U(spark, sf), _all_unit_cols))


# ---- E6: duplicates ----------------------------------------------------------------
@register("e06_duplicates", sql=with_units(
    "SELECT count(*) - count(DISTINCT unit_id) AS dup_keys, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM units) d) AS dup_rows FROM units"))
def e06_duplicates(spark, sf):
    return P.duplicates(U(spark, sf), "unit_id")


# ---- E7: cardinality ---------------------------------------------------------------
_cats = ["occupation", "area", "segment"]


@register("e07_cardinality", sql=with_units(union_sql(
    _cats, "SELECT '{c}' AS column, count(DISTINCT {c}) AS levels, count(*) FILTER (WHERE {c} IS NULL) AS n_missing FROM units")))
def e07_cardinality(spark, sf):
    return P.cardinality(U(spark, sf), _cats)


# ---- E8 / E9: value counts -----------------------------------------------------------
@register("e08_value_counts_target", sql=with_units(rsql(
    """SELECT target, n, n * 100.0 / sum(n) OVER () AS pct, max(n) OVER () * 1.0 / min(n) OVER () AS imbalance
       FROM (SELECT target, count(*) AS n FROM units GROUP BY target) g""", r6="pct imbalance")))
def e08_value_counts_target(spark, sf):
    return rounded(P.value_counts(U(spark, sf), "target"))


@register("e08_value_counts_occupation", sql=with_units(rsql(
    """SELECT occupation, n, n * 100.0 / sum(n) OVER () AS pct, max(n) OVER () * 1.0 / min(n) OVER () AS imbalance
       FROM (SELECT occupation, count(*) AS n FROM units GROUP BY occupation) g""", r6="pct imbalance")))
def e08_value_counts_occupation(spark, sf):
    return rounded(P.value_counts(U(spark, sf), "occupation"))


@register("e09_share_at_risk_by_area", sql=with_units(rsql(
    """SELECT area, n * 1.0 / sum(n) OVER () AS share
       FROM (SELECT area, count(*) AS n FROM units WHERE target = 0 AND area IS NOT NULL GROUP BY area) g""", r6="share")))
def e09_share_at_risk_by_area(spark, sf):
    return rounded(P.normalized_counts(U(spark, sf).filter(F.col("target") == 0), "area"))


# ---- E10: rate by group ----------------------------------------------------------------
@register("e10_rate_by_occupation", sql=with_units(rsql(
    "SELECT occupation, avg(target) AS rate, count(*) AS n FROM units WHERE occupation IS NOT NULL GROUP BY occupation", "rate")))
def e10_rate_by_occupation(spark, sf):
    return rounded(P.rate_by_group(U(spark, sf), "occupation", "target"))


@register("e10_weighted_rate_by_segment", sql=with_units(rsql(
    "SELECT segment, sum(target * weight) / sum(weight) AS rate, count(*) AS n FROM units WHERE segment IS NOT NULL GROUP BY segment",
    "rate")))
def e10_weighted_rate_by_segment(spark, sf):
    return rounded(P.rate_by_group(U(spark, sf), "segment", "target", weight="weight"))


# ---- E11: lift of a participation flag ---------------------------------------------------
_lift_parts = ["rent", "education", "entertainment", "insurance", "eating_out"]


_e11 = union_sql(_lift_parts, (
    "SELECT '{c}' AS part, avg(CASE WHEN {c}_share > 0 THEN NULL ELSE target END) AS rate_no, "
    "avg(CASE WHEN {c}_share > 0 THEN target END) AS rate_yes FROM units"))


@register("e11_flag_lift", sql=with_units(rsql(
    f"SELECT part, rate_no, rate_yes, rate_yes - rate_no AS lift FROM ({_e11}) z", r6="rate_no rate_yes lift")))
def e11_flag_lift(spark, sf):
    u = U(spark, sf)
    outs = None
    for p in _lift_parts:
        f = P.flag_lift(u.withColumn("_f", (F.col(f"{p}_share") > 0).cast("int")), "_f", "target")
        f = f.select(F.lit(p).alias("part"), "rate_no", "rate_yes", "lift")
        outs = f if outs is None else outs.unionByName(f)
    return rounded(outs)


# ---- E12: rate by missingness ------------------------------------------------------------
@register("e12_rate_by_missing_segment", sql=with_units(rsql(
    "SELECT segment IS NULL AS missing, avg(target) AS rate, count(*) AS n FROM units GROUP BY segment IS NULL", "rate")))
def e12_rate_by_missing_segment(spark, sf):
    return rounded(P.rate_by_missing(U(spark, sf), "segment", "target"))


# ---- E13: weighted mean ---------------------------------------------------------------------
@register("e13_weighted_mean", sql=with_units(rsql(
    "SELECT avg(target) AS rate, sum(target * weight) / sum(weight) AS weighted_rate FROM units", "rate weighted_rate")))
def e13_weighted_mean(spark, sf):
    return rounded(P.weighted_mean(U(spark, sf), "target", "weight"))


# ---- E14 / E15: threshold sweep -------------------------------------------------------------
_sweep = union_sql(THRESHOLD_SWEEP, (
    "SELECT {c!r}::DOUBLE AS threshold, count(*) FILTER (WHERE rate >= {c!r}::DOUBLE) AS n_met, count(*) AS n, "
    "avg(CASE WHEN (CASE WHEN rate >= {c!r}::DOUBLE THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS agreement FROM units"))


@register("e14_threshold_sweep", sql=with_units(rsql(
    f"""SELECT threshold, n_met * 1.0 / n AS rate, n_met,
        greatest(n_met * 1.0 / n, 1 - n_met * 1.0 / n) / least(n_met * 1.0 / n, 1 - n_met * 1.0 / n) AS imbalance, agreement
        FROM ({_sweep}) s""", r6="threshold rate imbalance agreement")))
def e14_threshold_sweep(spark, sf):
    return rounded(P.threshold_sweep(U(spark, sf), "rate", THRESHOLD_SWEEP, y="target"))


# ---- E16: correlation with one column ---------------------------------------------------------
@register("e16_corr_parts_income", sql=with_units(rsql(union_sql(
    PARTS, "SELECT '{c}' AS column, corr({c}, income) AS r FROM units"), r6="r")))
def e16_corr_parts_income(spark, sf):
    return rounded(P.corr_with(U(spark, sf), PARTS, "income"))


@register("e16_corr_shares_log_income", sql=with_units(rsql(union_sql(
    SHARES, "SELECT '{c}' AS column, corr({c}, log_income) AS r FROM units"), r6="r")))
def e16_corr_shares_log_income(spark, sf):
    return rounded(P.corr_with(U(spark, sf), SHARES, "log_income"))


# ---- E17-E19: correlation matrix -----------------------------------------------------------------
def _corr_long_sql(cols):
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    upper = union_sql(pairs, (
        "SELECT '{c[0]}' AS a, '{c[1]}' AS b, "
        "CASE WHEN '{c[0]}' = '{c[1]}' THEN 1.0 ELSE corr({c[0]}, {c[1]}) END AS r FROM units"))
    return f"SELECT a, b, r FROM ({upper}) u UNION ALL SELECT b AS a, a AS b, r FROM ({upper}) l WHERE a <> b"


@register("e17_corr_matrix_shares", sql=with_units(rsql(_corr_long_sql(SHARES), r6="r")))
def e17_corr_matrix_shares(spark, sf):
    return rounded(P.corr_matrix(U(spark, sf), SHARES))


@register("e18_offdiag_summary", sql=with_units(rsql(f"""
    SELECT avg(r) AS mean_r, avg(abs(r)) AS mean_abs_r, avg(CASE WHEN r < 0 THEN 1.0 ELSE 0.0 END) AS share_negative,
      min(r) AS min_r, arg_min(a || '|' || b, (r, a, b)) AS min_pair,
      max(r) AS max_r, arg_min(a || '|' || b, (-r, a, b)) AS max_pair
    FROM ({_corr_long_sql(SHARES)}) c WHERE a <> b""", r6="mean_r mean_abs_r share_negative min_r max_r")))
def e18_offdiag_summary(spark, sf):
    return rounded(P.offdiag_summary(P.corr_matrix(U(spark, sf), SHARES)))


@register("e19_top_pairs", sql=with_units(rsql(f"""
    SELECT a, b, r, abs(r) AS abs_r FROM ({_corr_long_sql(NUMERIC + SHARES)}) c
    WHERE a < b ORDER BY abs_r DESC, a, b LIMIT 8""", r6="r abs_r")))
def e19_top_pairs(spark, sf):
    return rounded(P.top_pairs(P.corr_matrix(U(spark, sf), NUMERIC + SHARES), 8))


# ---- E20 / E21: contingency -------------------------------------------------------------------------
@register("e20_crosstab_occupation_area", sql=with_units(
    "SELECT occupation, area, count(*) AS n FROM units WHERE occupation IS NOT NULL AND area IS NOT NULL GROUP BY occupation, area"))
def e20_crosstab_occupation_area(spark, sf):
    return P.crosstab(U(spark, sf), "occupation", "area")


@register("e21_crosstab_row_share", sql=with_units(rsql(
    """SELECT occupation, area, n, n * 1.0 / sum(n) OVER (PARTITION BY occupation) AS share
       FROM (SELECT occupation, area, count(*) AS n FROM units WHERE occupation IS NOT NULL AND area IS NOT NULL
             GROUP BY occupation, area) g""", r6="share")))
def e21_crosstab_row_share(spark, sf):
    return rounded(P.crosstab(U(spark, sf), "occupation", "area", normalize=True))


# ---- E22 / D5: pivot with a fixed domain -------------------------------------------------------------
_AREAS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@register("e22_pivot_rate_target_area", sql=with_units(rsql(
    "SELECT target, " + ", ".join(f"avg(CASE WHEN area = '{a}' THEN rate END) AS \"{a}\"" for a in _AREAS)
    + " FROM units GROUP BY target", r6=[f'"{a}"' for a in _AREAS])))
def e22_pivot_rate_target_area(spark, sf):
    long = U(spark, sf).groupBy("target", "area").agg(F.avg("rate").alias("m"))
    return rounded(P.pivot_wide(long, "target", "area", "m", _AREAS))


# ---- E24: median by group ---------------------------------------------------------------------------------
@register("e24_median_shares_by_area", sql=with_units(rsql(union_sql(
    SHARES, "SELECT area, '{c}' AS column, quantile_cont({c}, 0.5) AS median FROM units WHERE area IS NOT NULL GROUP BY area"),
    r6="median")))
def e24_median_shares_by_area(spark, sf):
    return rounded(P.median_by_group(U(spark, sf), "area", SHARES))


# ---- E25: segment profile -----------------------------------------------------------------------------------
@register("e25_segment_profile", sql=with_units(rsql(
    """SELECT occupation, count(*) AS n, quantile_cont(income, 0.5) AS median_income, quantile_cont(size, 0.5) AS median_size,
         avg(target) AS rate, quantile_cont(rate, 0.5) AS median_rate, count(*) * 100.0 / sum(count(*)) OVER () AS pct
       FROM units GROUP BY occupation""", r6="median_size rate median_rate pct", r2="median_income")))
def e25_segment_profile(spark, sf):
    return rounded(P.segment_profile(U(spark, sf), "occupation", "income", "size", "target", "rate"),
                   money=["median_income"])


# ---- E26 / E27: signature and zero pattern per segment -----------------------------------------------------------
@register("e26_mean_shares_by_area", sql=with_units(rsql(union_sql(
    SHARES, "SELECT area, '{c}' AS column, avg({c}) AS mean FROM units WHERE area IS NOT NULL GROUP BY area"), r6="mean")))
def e26_mean_shares_by_area(spark, sf):
    return rounded(P.mean_by_segment(U(spark, sf), "area", SHARES))


_z_sig = " || ".join(f"CAST(CAST(round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 0) AS INTEGER) AS VARCHAR)" for c in SHARES)


@register("e27_zero_rate_by_area", sql=with_units(rsql(
    f"""WITH sig AS (SELECT area, {_z_sig} AS signature FROM units WHERE area IS NOT NULL GROUP BY area),
       z AS ({union_sql(SHARES, "SELECT area, '{c}' AS column, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate FROM units WHERE area IS NOT NULL GROUP BY area")})
       SELECT z.area, sig.signature, z.column, z.zero_rate FROM z JOIN sig ON z.area = sig.area""", r6="zero_rate")))
def e27_zero_rate_by_area(spark, sf):
    return rounded(P.zero_rate_by_segment(U(spark, sf), "area", SHARES))


# ---- E28: spread within strata ----------------------------------------------------------------------------------
@register("e28_spread_within_size", sql=with_units(rsql(
    """WITH cell AS (SELECT size, area, avg(target) AS r FROM units WHERE area IS NOT NULL GROUP BY size, area),
            w AS (SELECT avg(s) AS spread_within FROM (SELECT size, max(r) - min(r) AS s FROM cell GROUP BY size) x),
            raw AS (SELECT max(r) - min(r) AS spread_raw FROM (SELECT area, avg(target) AS r FROM units WHERE area IS NOT NULL GROUP BY area) y)
       SELECT spread_raw, spread_within, spread_within / nullif(spread_raw, 0) AS surviving FROM raw, w""",
    r6="spread_raw spread_within surviving")))
def e28_spread_within_size(spark, sf):
    return rounded(P.stratified_spread(U(spark, sf), "size", "area", "target"))


# ---- E30: histogram -----------------------------------------------------------------------------------------------
@register("e30_histogram_log_income", sql=with_units(rsql(f"""
    WITH mm AS (SELECT min(log_income) AS lo, max(log_income) AS hi FROM units),
         b AS (SELECT least(CAST(floor((log_income - lo) / ((hi - lo) / {HIST_BINS})) AS INTEGER), {HIST_BINS - 1}) AS bin
               FROM units, mm WHERE log_income IS NOT NULL)
    SELECT bin, lo + bin * ((hi - lo) / {HIST_BINS}) AS lo, lo + (bin + 1) * ((hi - lo) / {HIST_BINS}) AS hi, count(*) AS n
    FROM b, mm GROUP BY bin, mm.lo, mm.hi""", r6="lo hi")))
def e30_histogram_log_income(spark, sf):
    return rounded(P.histogram(U(spark, sf), "log_income", HIST_BINS))


# ---- E31: box statistics ------------------------------------------------------------------------------------------
@register("e31_box_rate_by_area", sql=with_units(rsql("""
    WITH q AS (SELECT area, quantile_cont(rate, 0.25) AS q1, quantile_cont(rate, 0.5) AS median, quantile_cont(rate, 0.75) AS q3
               FROM units WHERE area IS NOT NULL AND rate IS NOT NULL GROUP BY area)
    SELECT u.area, q1, median, q3,
      min(CASE WHEN rate >= q1 - 1.5 * (q3 - q1) AND rate <= q3 + 1.5 * (q3 - q1) THEN rate END) AS whisker_lo,
      max(CASE WHEN rate >= q1 - 1.5 * (q3 - q1) AND rate <= q3 + 1.5 * (q3 - q1) THEN rate END) AS whisker_hi,
      count(*) AS n
    FROM units u JOIN q ON u.area = q.area WHERE rate IS NOT NULL GROUP BY u.area, q1, median, q3""",
    r6="q1 median q3 whisker_lo whisker_hi")))
def e31_box_rate_by_area(spark, sf):
    return rounded(P.box_stats(U(spark, sf), "area", "rate"))


# ---- E32: arg extremes ---------------------------------------------------------------------------------------------
@register("e32_argextreme_rate", sql=with_units(rsql(
    "SELECT arg_min(unit_id, (rate, unit_id)) AS argmin, min(rate) AS min, arg_min(unit_id, (-rate, unit_id)) AS argmax, max(rate) AS max FROM units",
    r6="min max")))
def e32_argextreme_rate(spark, sf):
    return rounded(P.argextreme(U(spark, sf), "rate", "unit_id"))


# ---- E33: best row per group ----------------------------------------------------------------------------------------
@register("e33_best_unit_per_area", sql=with_units(rsql(
    """SELECT area, unit_id, rate FROM (SELECT area, unit_id, rate,
         row_number() OVER (PARTITION BY area ORDER BY rate DESC, unit_id) AS r FROM units WHERE area IS NOT NULL) t WHERE r = 1""",
    r6="rate")))
def e33_best_unit_per_area(spark, sf):
    u = U(spark, sf).filter(F.col("area").isNotNull()).select("area", "unit_id", "rate")
    return rounded(P.best_per_group(u, "area", "rate", "unit_id"))


# ---- E34: spread of group means ----------------------------------------------------------------------------------------
@register("e34_spread_of_means", sql=with_units(rsql(
    "SELECT stddev_samp(m) AS sensitivity FROM (SELECT size, avg(rate) AS m FROM units GROUP BY size) g", r6="sensitivity")))
def e34_spread_of_means(spark, sf):
    return rounded(P.spread_of_means(U(spark, sf), "size", "rate"))


# ---- A10: shape -------------------------------------------------------------------------------------------------------
@register("a10_shape", sql=with_units(f"SELECT count(*) AS n_rows, {len(_all_unit_cols)} AS n_cols FROM units"))
def a10_shape(spark, sf):
    u = U(spark, sf)
    return u.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(u.columns)))


# ---- C3: complete-case filter ----------------------------------------------------------------------------------------
@register("c03_complete_case", sql=with_units(
    "SELECT count(*) AS n_before, count(*) FILTER (WHERE segment IS NULL OR area IS NULL) AS n_dropped, "
    "count(*) FILTER (WHERE segment IS NOT NULL AND area IS NOT NULL) AS n_after FROM units"))
def c03_complete_case(spark, sf):
    u = U(spark, sf)
    ok = F.col("segment").isNotNull() & F.col("area").isNotNull()
    return u.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(~ok).alias("n_dropped"), F.count_if(ok).alias("n_after"))


# ---- C5: seeded sample ---------------------------------------------------------------------------------------------------
@register("c05_seeded_sample", sql=with_units(rsql(
    f"SELECT unit_id, rate FROM units ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}'), unit_id LIMIT {ROW_SAMPLE}", r6="rate")))
def c05_seeded_sample(spark, sf):
    from ..operators.splits import seeded_sample

    return rounded(seeded_sample(U(spark, sf), "unit_id", ROW_SAMPLE, SEED).select("unit_id", "rate"))
