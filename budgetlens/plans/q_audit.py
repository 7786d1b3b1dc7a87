"""Queries for roles, audit, compositional transforms, binning and preprocessing (A8, H*, I*, F1-F5, F10, B13-B16, J1-J7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import CALIBRATION_BINS, SEED, TARGET_THRESHOLD, THRESHOLD_SWEEP, WINSOR_Q
from ..operators import audit as A
from ..operators import binning as BN
from ..operators import features as FE
from ..operators import profile as P
from ..operators import roles as RL
from ..operators import simplex as SX
from ..operators.splits import seeded_pairs
from ..spec import CATEGORICALS, PARTS, SHARES
from .common import rounded, rsql, union_sql
from .registry import register
from .sqlfeatures import CORE_SF001, ZERO_INFLATED_SF001, with_features
from .sqlviews import D, nz, with_units
from .tables import build_features, features_table, units_table

CORE_NAMES = [c.removesuffix("_share") for c in CORE_SF001]
CLR_COLS = [f"{c}_clr" for c in CORE_NAMES]
U = units_table
FT = features_table


# ---- A8: column catalogue ----------------------------------------------------------------------
_ROLES = RL.unit_roles(PARTS)
_UNIT_COLS = ["unit_id", "weight", "income", "log_income", "size", "dependents", "occupation", "area", "segment",
              "debt_to_income", *SHARES, "has_flag", *PARTS, "total", "residual", "rate", "target"]


@register("a08_role_counts", sql=with_units(
    "SELECT role, count(*) AS n_columns, CAST(sum(n_null) AS BIGINT) AS n_null FROM (" + union_sql(
        _UNIT_COLS, "SELECT '" + "{c}" + "' AS col, count(*) FILTER (WHERE {c} IS NULL) AS n_null FROM units") + ") c JOIN (VALUES "
    + ", ".join(f"('{c}', '{_ROLES.role_of(c)}')" for c in _UNIT_COLS) + ") r(col2, role) ON c.col = r.col2 GROUP BY role"))
def a08_role_counts(spark, sf):
    cat = RL.catalogue(U(spark, sf), _ROLES)
    return cat.groupBy("role").agg(F.count(F.lit(1)).alias("n_columns"), F.sum("n_null").cast("long").alias("n_null"))


@register("a08_catalogue", sql=with_units(union_sql(_UNIT_COLS, (
    "SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS n_null, "
    "count(DISTINCT {c}) AS n_distinct FROM units"))))
def a08_catalogue(spark, sf):
    return RL.catalogue(U(spark, sf), _ROLES).select("column", "n_null", "n_distinct")


# ---- H1-H8: audit -------------------------------------------------------------------------------
@register("h01_identity_error", sql=with_units(rsql(
    "SELECT max(abs(residual - (income - total))) AS max_abs_error FROM units", r6="max_abs_error")))
def h01_identity_error(spark, sf):
    return rounded(A.identity_error(U(spark, sf), "residual", "income", "total"))


@register("h02_reconciliation", sql=with_units(rsql(f"""
    SELECT max(gap) AS max_gap, quantile_cont(gap, 0.5) AS median_gap,
      avg(CASE WHEN gap / nullif(t, 0) < {D(0.01)} THEN 1.0 ELSE 0.0 END) AS share_within, corr(t, s) AS corr
    FROM (SELECT total AS t, {nz(PARTS)} AS s, abs(total - ({nz(PARTS)})) AS gap FROM units) g""",
    r6="max_gap median_gap share_within corr")))
def h02_reconciliation(spark, sf):
    return rounded(A.reconciliation(U(spark, sf), "total", PARTS))


@register("h03_reconstruction", sql=with_units(rsql(f"""
    SELECT avg(CASE WHEN (CASE WHEN (income - ({nz(PARTS)})) / income >= {D(TARGET_THRESHOLD)} THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS agreement_raw_parts,
      avg(CASE WHEN (CASE WHEN ({nz([f"{p} / income" for p in PARTS])}) <= {D(1 - TARGET_THRESHOLD)} THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS agreement_income_ratios
    FROM units""", r6="agreement_raw_parts agreement_income_ratios")))
def h03_reconstruction(spark, sf):
    return rounded(A.reconstruction(U(spark, sf), "income", PARTS, "target", TARGET_THRESHOLD))


@register("h05_closure_check", sql=with_units(rsql(f"""
    SELECT min({nz(SHARES)}) AS min_sum, max({nz(SHARES)}) AS max_sum,
      greatest({", ".join(f"abs(corr({c}, rate))" for c in SHARES)}) AS max_abs_corr FROM units""",
    r6="min_sum max_sum max_abs_corr")))
def h05_closure_check(spark, sf):
    return rounded(A.closure_check(U(spark, sf), SHARES, "rate"))


@register("h06_reserved_rates", sql=with_units(rsql(
    "SELECT 'has_flag' AS \"column\", avg(has_flag) AS mean FROM units", r6="mean")))
def h06_reserved_rates(spark, sf):
    return rounded(A.reserved_rates(U(spark, sf), ["has_flag"]))


@register("h07_leakage_scan", sql=with_units(rsql(f"""
    SELECT 'raw_parts' AS candidate, avg(CASE WHEN (CASE WHEN (income - total) / income >= {D(TARGET_THRESHOLD)} THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) AS agreement FROM units
    UNION ALL
    SELECT 'share_sum', avg(CASE WHEN (CASE WHEN ({nz(SHARES)}) <= {D(1 - TARGET_THRESHOLD)} THEN 1 ELSE 0 END) = target THEN 1.0 ELSE 0.0 END) FROM units""",
    r6="agreement")))
def h07_leakage_scan(spark, sf):
    from ..functions.columns import nz_sum

    u = U(spark, sf)
    _ROLES.assert_safe(["log_income", *SHARES])
    cands = {
        "raw_parts": F.try_divide(F.col("income") - F.col("total"), F.col("income")) >= F.lit(TARGET_THRESHOLD),
        "share_sum": nz_sum(SHARES) <= F.lit(1 - TARGET_THRESHOLD),
    }
    return rounded(RL.leakage_scan(u, cands, "target"))


@register("h08_external_validation", sql=with_units(rsql(
    """SELECT 'has_flag' AS "column", avg(CASE WHEN target = 1 THEN has_flag END) AS rate_met,
         avg(CASE WHEN target = 0 THEN has_flag END) AS rate_not_met,
         avg(CASE WHEN target = 1 THEN has_flag END) - avg(CASE WHEN target = 0 THEN has_flag END) AS lift FROM units""",
    r6="rate_met rate_not_met lift")))
def h08_external_validation(spark, sf):
    return rounded(A.external_validation(U(spark, sf), ["has_flag"], "target"))


# ---- I1 / I2: zero sets ----------------------------------------------------------------------------
@register("i01_zero_sets", sql=with_units(rsql(
    "SELECT \"column\", zero_rate, CAST(zero_rate > 0.3 AS INTEGER) AS zero_inflated, CAST(zero_rate < 0.2 AS INTEGER) AS core FROM ("
    + union_sql(SHARES, "SELECT '{c}' AS \"column\", avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate FROM units") + ") z",
    r6="zero_rate")))
def i01_zero_sets(spark, sf):
    zs = SX.fit_zero_sets(U(spark, sf), SHARES)
    z = P.zero_rates(U(spark, sf), SHARES)
    zi, core = F.array(*[F.lit(c) for c in zs.zero_inflated] or [F.lit("")]), F.array(*[F.lit(c) for c in zs.core] or [F.lit("")])
    return rounded(z.select("column", "zero_rate", F.array_contains(zi, F.col("column")).cast("int").alias("zero_inflated"),
                            F.array_contains(core, F.col("column")).cast("int").alias("core")))


# ---- I3 / I4: closure and zero replacement ---------------------------------------------------------
@register("i04_zero_replacement_deltas", sql=with_units(union_sql(
    CORE_SF001, "SELECT '{c}' AS \"column\", round(min(CASE WHEN {c} > 0 THEN {c} END) * " + D(0.65) + " * 1e9, 6) AS delta_e9 FROM units")))
def i04_zero_replacement_deltas(spark, sf):
    u = U(spark, sf)
    zs = SX.fit_zero_sets(u, SHARES)
    fit = SX.fit_zero_replacement(u, zs.core)
    row = u.agg(*[F.min(F.when(F.col(c) > 0, F.col(c))).alias(f"m{i}") for i, c in enumerate(zs.core)])
    out = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), (F.col(f"m{i}") * F.lit(0.65)).alias("delta"))
                                        for i, c in enumerate(zs.core)])))
    assert set(fit.deltas) == set(zs.core)
    return out.select("column", F.round(F.col("delta") * 1e9, 6).alias("delta_e9"))


@register("i03_closure_core", sql=with_units(rsql(
    f"SELECT unit_id, " + ", ".join(f"CASE WHEN ({nz(CORE_SF001)}) > 0 THEN {c} / ({nz(CORE_SF001)}) END AS {c}_closed" for c in CORE_SF001)
    + " FROM units", r6=[f"{c}_closed" for c in CORE_SF001])))
def i03_closure_core(spark, sf):
    u = U(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    return rounded(u.select("unit_id", *SX.closure(core)))


# ---- I5-I9 over the feature table -----------------------------------------------------------------
@register("i05_clr", sql=with_features(rsql("SELECT unit_id, " + ", ".join(CLR_COLS) + " FROM features", r6=CLR_COLS)))
def i05_clr(spark, sf):
    return rounded(FT(spark, sf).select("unit_id", *[c for c in FT(spark, sf).columns if c.endswith("_clr")]))


@register("i06_clr_checks", sql=with_features(rsql(
    f"SELECT max(abs({' + '.join(CLR_COLS)})) AS max_abs_row_sum, count({' + '.join(CLR_COLS)}) AS n_defined FROM features",
    r6="max_abs_row_sum")))
def i06_clr_checks(spark, sf):
    f = FT(spark, sf)
    return rounded(SX.clr_row_sum_check(f, [c for c in f.columns if c.endswith("_clr")]))


@register("i06_clr_columns", sql=with_features(rsql(union_sql(
    CLR_COLS, "SELECT '{c}' AS \"column\", avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max FROM features"), r6="mean std min max")))
def i06_clr_columns(spark, sf):
    f = FT(spark, sf)
    return rounded(SX.clr_column_summary(f, [c for c in f.columns if c.endswith("_clr")]))


def _ilr_sql():
    """sqrt(i / (i + 1)) * (mean of the first i columns - column i + 1), from the definition."""
    return ", ".join(f"sqrt({i}.0 / {i + 1}.0) * (({' + '.join(CLR_COLS[:i])}) / {i}.0 - {CLR_COLS[i]}) AS ilr_{i}" for i in range(1, len(CLR_COLS)))


_ILR = [f"ilr_{i + 1}" for i in range(len(CLR_COLS) - 1)]


@register("i07_ilr", sql=with_features(rsql(f"SELECT unit_id, {_ilr_sql()} FROM features", r6=_ILR)))
def i07_ilr(spark, sf):
    f = FT(spark, sf)
    clr_cols = [c for c in f.columns if c.endswith("_clr")]
    return rounded(f.select("unit_id", *SX.ilr(clr_cols)))


@register("i08_isometry", sql=with_features(rsql(f"""
    WITH il AS (SELECT unit_id, {", ".join(CLR_COLS)}, {_ilr_sql()} FROM features WHERE {" AND ".join(f"{c} IS NOT NULL" for c in CLR_COLS)}),
    a AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}'), unit_id) AS pair FROM il ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}'), unit_id LIMIT 400),
    b AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED + 1}'), unit_id) AS pair FROM il ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED + 1}'), unit_id LIMIT 400)
    SELECT max(abs(sqrt({" + ".join(f"pow(a.{c} - b.{c}, 2)" for c in CLR_COLS)}) - sqrt({" + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _ILR)}))) AS max_abs_diff,
      count(*) AS n_pairs FROM a JOIN b ON a.pair = b.pair""", r6="max_abs_diff")))
def i08_isometry(spark, sf):
    f = FT(spark, sf)
    clr_cols = [c for c in f.columns if c.endswith("_clr")]
    il = f.na.drop(subset=clr_cols).select("unit_id", *clr_cols, *SX.ilr(clr_cols))
    pairs = seeded_pairs(il, "unit_id", 400, SEED)
    return rounded(SX.isometry_check(pairs, clr_cols, _ILR))


@register("i09_zero_pattern_counts", sql=with_units(
    "SELECT " + " || ".join(f"CAST(CASE WHEN {c} = 0 THEN 1 ELSE 0 END AS VARCHAR)" for c in CORE_SF001)
    + " AS zero_key, count(*) AS n FROM units GROUP BY zero_key"))
def i09_zero_pattern_counts(spark, sf):
    u = U(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    return u.groupBy(SX.zero_pattern_key(core)).agg(F.count(F.lit(1)).alias("n"))


# ---- B13 / B16: Unknown level and winsorising -------------------------------------------------------
@register("b13_unknown_levels", sql=with_features("SELECT segment, count(*) AS n FROM features GROUP BY segment"))
def b13_unknown_levels(spark, sf):
    return FT(spark, sf).groupBy("segment").agg(F.count(F.lit(1)).alias("n"))


@register("b16_winsor_fit", sql=with_units(rsql(f"""
    SELECT cap, (SELECT count(*) FROM units WHERE debt_to_income > cap) AS n_above
    FROM (SELECT quantile_cont(debt_to_income, {D(WINSOR_Q)}) AS cap FROM units) c""", r6="cap")))
def b16_winsor_fit(spark, sf):
    w = FE.fit_winsor(U(spark, sf), "debt_to_income")
    return rounded(U(spark, sf).agg(F.lit(w.cap).alias("cap"), F.lit(w.n_above).cast("long").alias("n_above")))


@register("b16_features_table", sql=with_features(rsql("SELECT * FROM features",
    r6=["weight", *SHARES, "log_income", "debt_to_income_w", "dependency_ratio", *CLR_COLS, "rate"], r2="income")))
def b16_features_table(spark, sf):
    return rounded(FT(spark, sf))


# ---- F1: income deciles and the decile table (E29) ----------------------------------------------------
_DECILE_SQL = """dec_edges AS (SELECT quantile_cont(income, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM units),
ud AS (SELECT u.*, (SELECT count(*) FROM unnest(e) t(x) WHERE u.income > x) AS decile FROM units u, dec_edges)"""


@register("f01_income_deciles", sql=with_units(rsql(
    "SELECT CAST(decile AS INTEGER) AS decile, 1 - avg(target) AS rate, quantile_cont(income, 0.5) AS median_income, count(*) AS n FROM ud GROUP BY decile",
    r6="rate", r2="median_income"), _DECILE_SQL))
def f01_income_deciles(spark, sf):
    u = BN.with_quantile_bins(U(spark, sf), "income", 10, "decile")
    return rounded(P.decile_table(u, "decile", "target", "income"), money=["median_income"])


# ---- F3: equal-width bins of a probability-like column ---------------------------------------------------
_EDGES = BN.linspace(0.0, 1.0, CALIBRATION_BINS + 1)


@register("f03_equal_width_bins", sql=with_units(
    "SELECT bin, count(*) AS n FROM (SELECT CAST(CASE WHEN groceries_share > 0 AND groceries_share <= 1.0 THEN "
    + " + ".join(f"(CASE WHEN groceries_share > {D(e)} THEN 1 ELSE 0 END)" for e in _EDGES[1:-1])
    + " END AS INTEGER) AS bin FROM units) b GROUP BY bin"))
def f03_equal_width_bins(spark, sf):
    return U(spark, sf).select(BN.equal_width_bin("groceries_share", _EDGES).alias("bin")).groupBy("bin").agg(
        F.count(F.lit(1)).alias("n"))


# ---- F4: median split --------------------------------------------------------------------------------------
@register("f04_median_split", sql=with_units(rsql(
    """SELECT CAST(income <= m AS INTEGER) AS is_low, avg(target) AS rate, count(*) AS n
       FROM units, (SELECT quantile_cont(income, 0.5) AS m FROM units) q GROUP BY is_low""", r6="rate")))
def f04_median_split(spark, sf):
    u = BN.median_split(U(spark, sf), "income")
    return rounded(u.groupBy("is_low").agg(F.avg("target").alias("rate"), F.count(F.lit(1)).alias("n")))


# ---- F5: difference to the previous row ----------------------------------------------------------------------
_sweep_rows = union_sql(THRESHOLD_SWEEP, "SELECT {c!r}::DOUBLE AS threshold, avg(CASE WHEN rate >= {c!r}::DOUBLE THEN 1.0 ELSE 0.0 END) AS rate FROM units")


@register("f05_sweep_diff", sql=with_units(rsql(
    f"SELECT threshold, rate, rate - lag(rate) OVER (ORDER BY threshold) AS diff FROM ({_sweep_rows}) s", r6="threshold rate diff")))
def f05_sweep_diff(spark, sf):
    s = P.threshold_sweep(U(spark, sf), "rate", THRESHOLD_SWEEP).select("threshold", "rate")
    return rounded(BN.diff_previous(s, "threshold", "rate"))


# ---- F10: nearest row to a target value --------------------------------------------------------------------------
@register("f10_nearest_to_threshold", sql=with_units(rsql(
    f"SELECT unit_id, rate FROM units ORDER BY abs(rate - {D(TARGET_THRESHOLD)}), unit_id LIMIT 1", r6="rate")))
def f10_nearest_to_threshold(spark, sf):
    return rounded(BN.nearest(U(spark, sf).select("unit_id", "rate"), "rate", TARGET_THRESHOLD, "unit_id"))


# ---- J1-J4, J6, J7: preprocessing fits -------------------------------------------------------------------------------
_NUM = ["log_income", "size", "dependents", "debt_to_income_w", "dependency_ratio", "groceries_share"]


@register("j01_median_impute", sql=with_features(rsql(union_sql(
    _NUM, "SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS median FROM features"), r6="median")))
def j01_median_impute(spark, sf):
    fit = FE.fit_median_imputer(FT(spark, sf), _NUM)
    f = FT(spark, sf)
    return rounded(f.agg(*[F.lit(fit.medians[c]).alias(c) for c in _NUM]).unpivot([], _NUM, "column", "median"))


@register("j02_standard_scaler", sql=with_features(rsql(union_sql(
    _NUM, "SELECT '{c}' AS \"column\", avg({c}) AS center, stddev_pop({c}) AS scale FROM features"), r6="center scale")))
def j02_standard_scaler(spark, sf):
    f = FT(spark, sf)
    fit = FE.fit_standard_scaler(f, _NUM, ddof=0)
    return rounded(f.sparkSession.createDataFrame([(c, float(fit.center[c]), float(fit.scale[c])) for c in _NUM], "column string, center double, scale double"))


@register("j03_robust_scaler", sql=with_features(rsql(union_sql(_NUM, (
    "SELECT '{c}' AS \"column\", quantile_cont({c}, 0.5) AS center, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 "
    "THEN 1.0 ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS scale FROM features")), r6="center scale")))
def j03_robust_scaler(spark, sf):
    f = FT(spark, sf)
    fit = FE.fit_robust_scaler(f, _NUM)
    rows = [(c, float(fit.center[c]), float(fit.scale[c])) for c in _NUM]
    return rounded(f.sparkSession.createDataFrame(rows, "column string, center double, scale double"))


@register("j04_one_hot_counts", sql=with_features(
    "SELECT 'occupation_' || occupation AS \"column\", count(*) AS n_ones FROM features GROUP BY occupation"))
def j04_one_hot_counts(spark, sf):
    f = FT(spark, sf)
    levels = FE.fit_levels(f, ["occupation"])["occupation"]
    enc = f.select(*FE.one_hot("occupation", levels))
    row = enc.agg(*[F.sum(c).cast("long").alias(c) for c in enc.columns])
    return row.unpivot([], enc.columns, "column", "n_ones")


@register("j06_zscore_sample_sd", sql=with_features(rsql(f"""
    WITH m AS (SELECT {", ".join(f"median({c}) AS {c}" for c in _NUM)} FROM features),
    z AS ({union_sql(_NUM, "SELECT '{c}' AS c, coalesce(f.{c}, m.{c}) AS x FROM features f, m")})
    SELECT c AS "column", avg(x) AS center, stddev_samp(x) AS scale FROM z GROUP BY c HAVING min(x) < max(x)""", r6="center scale")))
def j06_zscore_sample_sd(spark, sf):
    f = FT(spark, sf)
    fit, _ = FE.fit_zscores(f.withColumn("always_one", F.lit(1.0)), [*_NUM, "always_one"])  # the constant column is dropped
    rows = [(c, float(v), float(fit.scale[c])) for c, v in fit.center.items()]
    return rounded(f.sparkSession.createDataFrame(rows, "column string, center double, scale double"))


@register("j07_vif_of_two", sql=with_features(rsql("""
    SELECT c AS "column", 1 / (1 - pow(r, 2)) AS vif FROM (SELECT corr(log_income, groceries_share) AS r FROM features), (VALUES ('log_income'), ('groceries_share')) t(c)""",
    r6="vif")))
def j07_vif_of_two(spark, sf):
    """VIF of two columns, 1 / (1 - r^2); a constant third one has none."""
    f = FT(spark, sf).withColumn("always_one", F.lit(1.0))
    return rounded(f.sparkSession.createDataFrame(FE.vif(f, ["log_income", "always_one", "groceries_share"]), "column string, vif double"))


@register("j07_vif")
def j07_vif(spark, sf):
    f = FT(spark, sf)
    cols = ["log_income", "size", "dependents", "debt_to_income_w", "dependency_ratio", *SHARES]
    filled = f.select(*FE.imputed(cols, FE.fit_median_imputer(f, cols)))
    return f.sparkSession.createDataFrame(FE.vif(filled, cols), "column string, vif double")


# ---- B17: plausibility checks -------------------------------------------------------------------------------
from ..constants import PLAUSIBILITY_CHECKS  # noqa: E402

@register("b17_plausibility", sql=with_units(rsql(union_sql(PLAUSIBILITY_CHECKS, (
    "SELECT '{c[0]}' AS \"check\", count(*) FILTER (WHERE {c[1]} {c[2]} {c[3]!r}::DOUBLE) AS n, "
    "avg(CASE WHEN {c[1]} {c[2]} {c[3]!r}::DOUBLE THEN 1.0 ELSE 0.0 END) AS share FROM units")), r6="share")))
def b17_plausibility(spark, sf):
    return rounded(A.plausibility(U(spark, sf), PLAUSIBILITY_CHECKS))
