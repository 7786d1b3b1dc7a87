"""Queries for persona validity over the zero-pattern segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SEED, SILHOUETTE_SAMPLE
from ..operators import cluster as C
from ..operators import profile as P
from ..operators import simplex as SX
from ..operators.binning import with_quantile_bins
from ..spec import SHARES
from .common import rounded, rsql, union_sql
from .q_audit import CLR_COLS, _ILR, _ilr_sql
from .registry import register
from .sqlfeatures import CORE_SF001, ZERO_INFLATED_SF001, with_features
from .sqlviews import with_units
from .tables import features_table, units_table

_KEY = " || ".join(f"CAST(CASE WHEN {c} = 0 THEN 1 ELSE 0 END AS VARCHAR)" for c in CORE_SF001)
_PERSONA = f"""pu AS (SELECT *, {_KEY} AS persona FROM units),
pe AS (SELECT quantile_cont(income, [1.0 / 3, 2.0 / 3]) AS e FROM units),
pt AS (SELECT pu.*, CAST((SELECT count(*) FROM unnest(e) t(x) WHERE pu.income > x) AS INTEGER) AS tertile FROM pu, pe)"""


def personas(spark, sf):
    u = units_table(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    u = u.withColumn("persona", SX.zero_pattern_key(core, "persona"))
    return with_quantile_bins(u, "income", 3, "tertile")


def _ari_sql(a, b, src="pt"):
    return f"""WITH cells AS (SELECT {a}, {b}, count(*) * 1.0 AS n FROM {src} GROUP BY {a}, {b}),
      s AS (SELECT sum(n * (n - 1) / 2) AS sij, sum(n) AS N FROM cells),
      r AS (SELECT sum(n * (n - 1) / 2) AS si FROM (SELECT {a}, sum(n) AS n FROM cells GROUP BY {a}) x),
      c AS (SELECT sum(n * (n - 1) / 2) AS sj FROM (SELECT {b}, sum(n) AS n FROM cells GROUP BY {b}) y)
    SELECT CASE WHEN (si + sj) / 2 - si * sj / (N * (N - 1) / 2) = 0 THEN 1.0
      ELSE (sij - si * sj / (N * (N - 1) / 2)) / ((si + sj) / 2 - si * sj / (N * (N - 1) / 2)) END AS ari FROM s, r, c"""


@register("n06_ari_persona_tertile", sql=with_units(rsql(_ari_sql("persona", "tertile"), r6="ari"), _PERSONA))
def n06_ari_persona_tertile(spark, sf):
    return rounded(C.adjusted_rand(personas(spark, sf), "persona", "tertile"))


@register("n06_ari_persona_area", sql=with_units(rsql(_ari_sql("persona", "area", "(SELECT * FROM pt WHERE area IS NOT NULL) q"), r6="ari"), _PERSONA))
def n06_ari_persona_area(spark, sf):
    return rounded(C.adjusted_rand(personas(spark, sf).filter(F.col("area").isNotNull()), "persona", "area"))


_CHI = """WITH cells AS (SELECT persona, target, count(*) * 1.0 AS o FROM pt GROUP BY persona, target),
      e AS (SELECT *, sum(o) OVER (PARTITION BY persona) * sum(o) OVER (PARTITION BY target) / sum(o) OVER () AS e,
                  sum(o) OVER () AS N FROM cells),
      d AS (SELECT count(DISTINCT persona) AS r, count(DISTINCT target) AS c FROM cells),
      s AS (SELECT sum((o - e) * (o - e) / e) + (any_value(N) - sum(e)) AS chi2, any_value(N) AS N FROM e),
      t AS (SELECT chi2, CAST((r - 1) * (c - 1) AS INTEGER) AS dof, sqrt(chi2 / (N * greatest(least(r, c) - 1, 1))) AS cramers_v FROM s, d)
    """


@register("n07_chi_square_persona_target", sql=with_units(rsql(_CHI + "SELECT * FROM t", r6="chi2 cramers_v"), _PERSONA))
def n07_chi_square_persona_target(spark, sf):
    return rounded(C.chi_square(personas(spark, sf), "persona", "target"))


# the oracle adds up the lower tail's infinite series, far beyond its largest term; the Spark column is the upper tail's finite one
@register("n07_chi_square_pvalue", sql=with_units(rsql(_CHI + """SELECT t.*, CASE WHEN chi2 <= 0 OR dof <= 0 THEN 1.0 ELSE greatest(0, 1 - (
        SELECT sum(exp((k + dof / 2.0) * ln(chi2 / 2) - chi2 / 2 - lgamma(k + dof / 2.0 + 1))) FROM range(CAST(2000 + 2 * chi2 AS BIGINT)) r(k))) END AS p_value FROM t""",
    r6="chi2 cramers_v p_value"), _PERSONA))
def n07_chi_square_pvalue(spark, sf):
    return rounded(C.with_p_value(C.chi_square(personas(spark, sf), "persona", "target")))


@register("n05_persona_profile", sql=with_units(rsql(
    """SELECT persona, count(*) AS n, quantile_cont(income, 0.5) AS median_income, quantile_cont(size, 0.5) AS median_size,
         avg(target) AS rate, quantile_cont(rate, 0.5) AS median_rate, count(*) * 100.0 / sum(count(*)) OVER () AS pct
       FROM pt GROUP BY persona""", r6="median_size rate median_rate pct", r2="median_income"), _PERSONA))
def n05_persona_profile(spark, sf):
    return rounded(P.segment_profile(personas(spark, sf), "persona", "income", "size", "target", "rate"), money=["median_income"])


@register("n05_persona_signature", sql=with_units(rsql(union_sql(
    SHARES, "SELECT persona, '{c}' AS \"column\", avg({c}) AS mean FROM pt GROUP BY persona"), r6="mean"), _PERSONA))
def n05_persona_signature(spark, sf):
    return rounded(P.mean_by_segment(personas(spark, sf), "persona", SHARES))


@register("n05_persona_area_composition", sql=with_units(rsql(
    """SELECT persona, area, n, n * 1.0 / sum(n) OVER (PARTITION BY persona) AS share
       FROM (SELECT persona, area, count(*) AS n FROM pt WHERE area IS NOT NULL GROUP BY persona, area) g""", r6="share"), _PERSONA))
def n05_persona_area_composition(spark, sf):
    return rounded(P.crosstab(personas(spark, sf), "persona", "area", normalize=True))


@register("n05_persona_participation", sql=with_features(rsql(union_sql(
    [f"spends_on_{c.removesuffix('_share')}" for c in ZERO_INFLATED_SF001],
    "SELECT " + " || ".join(f"CAST(CASE WHEN {c} = 0 THEN 1 ELSE 0 END AS VARCHAR)" for c in CORE_SF001)
    + " AS persona, '{c}' AS \"column\", avg({c}) AS mean FROM features GROUP BY persona"), r6="mean")))
def n05_persona_participation(spark, sf):
    f = features_table(spark, sf)
    u = units_table(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    flags = [c for c in f.columns if c.startswith("spends_on_")]
    return rounded(P.mean_by_segment(f.withColumn("persona", SX.zero_pattern_key(core, "persona")), "persona", flags))


@register("n05_persona_zero_rates", sql=with_units(rsql(
    f"""WITH sig AS (SELECT persona, {" || ".join(f"CAST(CAST(round(avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END), 0) AS INTEGER) AS VARCHAR)" for c in CORE_SF001)} AS signature FROM pt GROUP BY persona),
       z AS ({union_sql(CORE_SF001, "SELECT persona, '{c}' AS column, avg(CASE WHEN {c} = 0 THEN 1.0 ELSE 0.0 END) AS zero_rate FROM pt GROUP BY persona")})
       SELECT z.persona, sig.signature, z.column, z.zero_rate FROM z JOIN sig ON z.persona = sig.persona""", r6="zero_rate"), _PERSONA))
def n05_persona_zero_rates(spark, sf):
    pu = personas(spark, sf)
    core = SX.fit_zero_sets(units_table(spark, sf), SHARES).core
    return rounded(P.zero_rate_by_segment(pu, "persona", core))


@register("n08_spread_within_tertile", sql=with_units(rsql(
    """WITH cell AS (SELECT tertile, persona, avg(target) AS r FROM pt GROUP BY tertile, persona),
            w AS (SELECT avg(s) AS spread_within FROM (SELECT tertile, max(r) - min(r) AS s FROM cell GROUP BY tertile) x),
            raw AS (SELECT max(r) - min(r) AS spread_raw FROM (SELECT persona, avg(target) AS r FROM pt GROUP BY persona) y)
       SELECT spread_raw, spread_within, spread_within / nullif(spread_raw, 0) AS surviving FROM raw, w""",
    r6="spread_raw spread_within surviving"), _PERSONA))
def n08_spread_within_tertile(spark, sf):
    return rounded(P.stratified_spread(personas(spark, sf), "tertile", "persona", "target"))


_SIL = f"""il AS (SELECT unit_id, {_ilr_sql()},
                  {" || ".join(f"CAST(CASE WHEN s.{c} = 0 THEN 1 ELSE 0 END AS VARCHAR)" for c in CORE_SF001)} AS persona
          FROM features f JOIN units s USING (unit_id) WHERE {" AND ".join(f"f.{c} IS NOT NULL" for c in CLR_COLS)}),
smp AS (SELECT * FROM il ORDER BY md5(CAST(unit_id AS VARCHAR) || '{SEED}'), unit_id LIMIT {SILHOUETTE_SAMPLE}),
pairs AS (SELECT a.unit_id, a.persona AS la, b.persona AS lb,
            sqrt({" + ".join(f"pow(a.{c} - b.{c}, 2)" for c in _ILR)}) AS d FROM smp a JOIN smp b ON a.unit_id <> b.unit_id),
per AS (SELECT unit_id, la, lb, avg(d) AS md FROM pairs GROUP BY unit_id, la, lb),
sz AS (SELECT persona, count(*) AS n FROM smp GROUP BY persona),
pa AS (SELECT unit_id, max(CASE WHEN la = lb THEN md END) AS a, min(CASE WHEN la <> lb THEN md END) AS b FROM per GROUP BY unit_id)"""


@register("n02_silhouette_ilr_persona", sql=with_features(rsql(
    """SELECT avg(CASE WHEN sz.n <= 1 OR pa.b IS NULL THEN 0.0 ELSE (pa.b - coalesce(pa.a, 0)) / greatest(coalesce(pa.a, 0), pa.b) END) AS silhouette,
         count(*) AS n FROM smp JOIN sz ON smp.persona = sz.persona LEFT JOIN pa ON smp.unit_id = pa.unit_id""", r6="silhouette"), _SIL))
def n02_silhouette_ilr_persona(spark, sf):
    f = features_table(spark, sf)
    u = units_table(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    clr_cols = [c for c in f.columns if c.endswith("_clr")]
    il = f.na.drop(subset=clr_cols).select("unit_id", *SX.ilr(clr_cols)).join(
        u.select("unit_id", SX.zero_pattern_key(core, "persona")), "unit_id")
    return rounded(C.silhouette(il, _ILR, "persona", "unit_id", SILHOUETTE_SAMPLE, SEED))


_SIL_ALL = _SIL.split("smp AS")[0] + f"""st AS (SELECT persona AS c, count(*) AS n, sum({" + ".join(f"{x} * {x}" for x in _ILR)}) AS q,
         {", ".join(f"sum({x}) AS s_{x}" for x in _ILR)} FROM il GROUP BY persona),
dist AS (SELECT il.unit_id, il.persona, st.c, st.n,
         greatest(st.n * ({" + ".join(f"il.{x} * il.{x}" for x in _ILR)}) - 2 * ({" + ".join(f"il.{x} * st.s_{x}" for x in _ILR)}) + st.q, 0) AS t FROM il, st),
ab AS (SELECT unit_id, max(CASE WHEN persona = c AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN persona <> c THEN t / n END) AS b FROM dist GROUP BY unit_id)"""


@register("n02_silhouette_all_rows", sql=with_features(rsql(
    "SELECT avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0.0 ELSE (b - a) / greatest(a, b) END) AS silhouette, count(*) AS n FROM ab",
    r6="silhouette"), _SIL_ALL))
def n02_silhouette_all_rows(spark, sf):
    """Squared-Euclidean silhouette over all rows; n02_silhouette_ilr_persona is the study's Euclidean one, defined on a seeded sample."""
    f, u = features_table(spark, sf), units_table(spark, sf)
    core = SX.fit_zero_sets(u, SHARES).core
    clr_cols = [c for c in f.columns if c.endswith("_clr")]
    il = f.na.drop(subset=clr_cols).select("unit_id", *SX.ilr(clr_cols)).join(u.select("unit_id", SX.zero_pattern_key(core, "persona")), "unit_id")
    return rounded(C.silhouette_squared(il, _ILR, "persona"))
