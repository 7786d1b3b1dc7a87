"""Scan/sink, lift, k-means sweep and findings queries."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from ..constants import CONTACT_BUDGETS, KMEANS_K, SEED, SILHOUETTE_SAMPLE
from ..operators import cluster as C
from ..operators import ingest
from ..operators import kmeans as KM
from ..operators import profile as P
from ..operators import simplex as SX
from ..operators import targeting as T
from ..operators.binning import with_quantile_bins
from ..functions.columns import first_non_missing, lookup
from ..operators.profile import melt
from ..session import checkpoint_dir
from ..spec import SHARES, STANDIN_SPEC
from .common import rounded, rsql
from .q_metrics import S, W, _capture_sql, _long
from .registry import memo_result, register
from .sqlviews import with_units
from .sqlfeatures import with_features
from .tables import exists, features_table, fingerprint, raw_table, units_table

_COUNTS = [c for c, _ in STANDIN_SPEC.count_labels]
_KEEP = ["unit_id", "weight", "income", "size", "dependents", *_COUNTS, "debt", "has_flag", *[f"item_{k}" for k in range(1, 51)]]


def _raw_tsv(spark, sf):
    """The raw wide table as tab-separated text with "NA" for missing cells (written once by Spark)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/budgetlens/raw_tsv_{fingerprint(spark, sf)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        raw_table(spark, sf).write.mode("overwrite").option("sep", "\t").option("header", True) \
            .option("nullValue", "NA").csv(path)
    return path


@register("a01_scan_tsv", sql=with_units(rsql(
    "SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _KEEP) + " FROM raw",
    r6=["weight", "size", "dependents", *_COUNTS, "has_flag", "unit_id", *[f"item_{k}" for k in range(1, 34)]],
    r2=["income", "debt", *[f"item_{k}" for k in range(34, 51)]])))
def a01_scan_tsv(spark, sf):
    df = ingest.scan_delimited(spark, _raw_tsv(spark, sf), _KEEP)
    return rounded(df, money=["debt"])


@register("a05_sink_roundtrip", sql=with_features(
    "SELECT f AS format, count(*) AS rows, CAST(sum(target) AS BIGINT) AS n_target, count(has_flag) AS n_flag FROM features, (VALUES ('parquet'), ('csv')) t(f) GROUP BY f"))
def a05_sink_roundtrip(spark, sf):
    """Write the feature table as Parquet and CSV and read both back, the CSV under the table's own types (A4, A5)."""
    f = features_table(spark, sf)
    base = f"{checkpoint_dir(spark).rstrip('/')}/budgetlens/sink_{fingerprint(spark, sf)}"
    f.write.mode("overwrite").parquet(f"{base}/parquet")
    f.write.mode("overwrite").option("header", True).csv(f"{base}/csv")
    back = {"parquet": spark.read.parquet(f"{base}/parquet"), "csv": spark.read.schema(f.schema).option("header", True).csv(f"{base}/csv")}
    out = [d.agg(F.count(F.lit(1)).alias("rows"), F.sum("target").cast("long").alias("n_target"), F.count("has_flag").alias("n_flag"))
           .withColumn("format", F.lit(name)) for name, d in back.items()]
    return out[0].unionByName(out[1])


@register("p02_lift_and_gain", sql=W(rsql(f"""
    WITH c AS ({_capture_sql(CONTACT_BUDGETS)})
    SELECT m.fraction, m.captured / r.captured AS lift_over_random, (m.captured - i.captured) * 100 AS gain_over_rule_pp
    FROM c m JOIN c r ON m.fraction = r.fraction AND r.strategy = 'random'
    JOIN c i ON m.fraction = i.fraction AND i.strategy = 'income_rule' WHERE m.strategy = 'model'""",
    r6="fraction lift_over_random gain_over_rule_pp")))
def p02_lift_and_gain(spark, sf):
    cap = T.capture_table(_long(S(spark, sf)), "strategy", "score", "unit_id", "at_risk", CONTACT_BUDGETS)
    w = cap.groupBy("fraction").agg(
        F.max(F.when(F.col("strategy") == "model", F.col("captured"))).alias("m"),
        F.max(F.when(F.col("strategy") == "random", F.col("captured"))).alias("r"),
        F.max(F.when(F.col("strategy") == "income_rule", F.col("captured"))).alias("i"))
    return rounded(w.select("fraction", (F.col("m") / F.col("r")).alias("lift_over_random"),
                            ((F.col("m") - F.col("i")) * 100).alias("gain_over_rule_pp")))


def _representations(spark, sf):
    f = features_table(spark, sf)
    clr_cols = [c for c in f.columns if c.endswith("_clr")]
    flags = [c for c in f.columns if c.startswith("spends_on_")]
    ilr_names = [f"ilr_{i + 1}" for i in range(len(clr_cols) - 1)]
    d = f.na.drop(subset=clr_cols).select("unit_id", *SHARES, *flags, *SX.ilr(clr_cols, ilr_names)).checkpoint()
    return d, {"raw shares": SHARES, "ilr core": ilr_names, "ilr + participation": ilr_names + flags}


@register("n03_kmeans_sweep")
@memo_result
def n03_kmeans_sweep(spark, sf):
    """Representation x k sweep: best-of-10 k-means inertia and silhouette over all rows."""
    d, reps = _representations(spark, sf)
    with ThreadPoolExecutor(max_workers=len(reps)) as ex:
        found = list(ex.map(lambda cols: KM.sweep(d, cols, "unit_id", KMEANS_K, 10, SEED), reps.values()))
    rows = [(name, m.k, m.silhouette, m.inertia) for name, fits in zip(reps, found, strict=True) for m in fits]
    out = spark.createDataFrame(rows, "representation string, k int, silhouette double, inertia double")
    from pyspark.sql import Window

    w = Window.partitionBy("representation").orderBy("k")
    return rounded(out.withColumn("relative_inertia", F.col("inertia") / F.first("inertia").over(w)))


@register("n04_pick_best_clustering")
def n04_pick_best_clustering(spark, sf):
    """Representation and k with the largest silhouette."""
    sweep = n03_kmeans_sweep(spark, sf)
    return sweep.agg(F.max_by(F.struct("representation", "k", "silhouette"), F.struct("silhouette", -F.col("k"))).alias("b")).select("b.*")


_PERSONAS: dict = {}


def kmeans_personas(spark, sf):
    """(labelled units, columns, fit): k-means with 20 starts at the representation and k that n04 picks; the label is ``persona``."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf))
    if key not in _PERSONAS:
        pick = n04_pick_best_clustering(spark, sf).first()
        d, reps = _representations(spark, sf)
        model = KM.sweep(d, reps[pick["representation"]], "unit_id", [pick["k"]], 20, SEED)[0]
        labels = KM.labelled(d, reps[pick["representation"]], model, "persona").select("unit_id", "persona")
        flags = [c for c in features_table(spark, sf).columns if c.startswith("spends_on_")]
        units = units_table(spark, sf).join(labels, "unit_id").join(features_table(spark, sf).select("unit_id", *flags), "unit_id").checkpoint()
        _PERSONAS[key] = (units, flags, model)
    return _PERSONAS[key]


def _persona_query(name: str, make) -> None:
    def run(spark, sf):
        units, flags, model = kmeans_personas(spark, sf)
        return rounded(make(spark, sf, units, flags, model))

    run.__name__, run.__doc__ = name, make.__doc__
    register(name)(run)


def _core(spark, sf):
    return SX.fit_zero_sets(units_table(spark, sf), SHARES).core


_persona_query("n05_kmeans_profile", lambda spark, sf, u, flags, m: P.segment_profile(u, "persona", "income", "size", "target", "rate"))
_persona_query("n05_kmeans_signature", lambda spark, sf, u, flags, m: P.mean_by_segment(u, "persona", SHARES))
_persona_query("n05_kmeans_zero_rates", lambda spark, sf, u, flags, m: P.zero_rate_by_segment(u, "persona", _core(spark, sf)))
_persona_query("n05_kmeans_participation", lambda spark, sf, u, flags, m: P.mean_by_segment(u, "persona", flags))
_persona_query("n05_kmeans_area_composition", lambda spark, sf, u, flags, m: P.crosstab(u, "persona", "area", normalize=True))
_persona_query("n05_kmeans_occupation_composition", lambda spark, sf, u, flags, m: P.crosstab(u, "persona", "occupation", normalize=True))
_persona_query("n06_kmeans_ari_zero_pattern", lambda spark, sf, u, flags, m: C.adjusted_rand(u.withColumn("pattern", SX.zero_pattern_key(_core(spark, sf), "pattern")), "persona", "pattern"))
_persona_query("n06_kmeans_ari_income", lambda spark, sf, u, flags, m: C.adjusted_rand(with_quantile_bins(u, "income", m.k, "band"), "persona", "band"))
_persona_query("n07_kmeans_chi_square", lambda spark, sf, u, flags, m: C.with_p_value(C.chi_square(u, "persona", "target")))
_persona_query("n08_kmeans_spread_within_decile", lambda spark, sf, u, flags, m: P.stratified_spread(with_quantile_bins(u, "income", 10, "decile"), "decile", "persona", "target"))


@register("p11_findings")
def p11_findings(spark, sf):
    """One row per number behind the recommendations, assembled from P1, P4, P9, P10."""
    from ..constants import IMPLAUSIBLE_RATE, TARGET_THRESHOLD
    from .q_metrics import _excess

    cap = T.capture_table(_long(S(spark, sf)), "strategy", "score", "unit_id", "at_risk", [0.25])
    m = [cap.select(F.concat(F.lit("captured_at_25pct_"), F.col("strategy")).alias("metric"), F.col("captured").alias("value")),
         cap.select(F.concat(F.lit("precision_at_25pct_"), F.col("strategy")).alias("metric"), F.col("precision").alias("value"))]
    g = T.gap_and_recoverable(_excess(spark, sf), SHARES, "income", "rate", TARGET_THRESHOLD)
    cs = T.closable_summary(g)
    m.append(cs.unpivot([], ["closable", "median_gap", "median_recoverable"], "metric", "value"))
    cav = T.measurement_caveat(units_table(spark, sf), "rate", "target", IMPLAUSIBLE_RATE)
    m.append(cav.select(F.col("share_implausible").cast("double"), F.col("share_of_at_risk_group").cast("double"))
             .unpivot([], ["share_implausible", "share_of_at_risk_group"], "metric", "value"))
    out = m[0]
    for x in m[1:]:
        out = out.unionByName(x)
    return rounded(out)


# fixed values: short codes of the market segments; FURNITURE has none on purpose
SEGMENT_CODES = {"AUTOMOBILE": "auto", "BUILDING": "build", "HOUSEHOLD": "home", "MACHINERY": "mach"}


@register("b07_first_non_missing", sql=with_units("SELECT unit_id, coalesce(segment, area) AS segment_or_area FROM units"))
def b07_first_non_missing(spark, sf):
    return units_table(spark, sf).select("unit_id", first_non_missing("segment", "area").alias("segment_or_area"))


@register("b08_code_lookup", sql=with_units(
    "SELECT unit_id, CASE segment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_CODES.items()) + " END AS code FROM units"))
def b08_code_lookup(spark, sf):
    return units_table(spark, sf).select("unit_id", lookup("segment", SEGMENT_CODES).alias("code"))


@register("b06_logs", sql=with_units(rsql("SELECT unit_id, ln(1 + greatest(debt_to_income, 0)) AS log1p_debt, exp(log_income) AS income_again FROM units", r6="log1p_debt", r2=["income_again"])))
def b06_logs(spark, sf):
    u = units_table(spark, sf)
    return rounded(u.select("unit_id", F.log1p(F.greatest("debt_to_income", F.lit(0))).alias("log1p_debt"), F.exp("log_income").alias("income_again")), money=["income_again"])


@register("d05_fixed_domain", sql=with_units("""
    SELECT d.segment, count(u.unit_id) AS n, d.pos FROM (VALUES ('MACHINERY', 1), ('NO SUCH SEGMENT', 2), ('BUILDING', 3)) d(segment, pos)
    LEFT JOIN units u ON u.segment = d.segment GROUP BY d.segment, d.pos"""))
def d05_fixed_domain(spark, sf):
    """Group counts over a stated list of groups in its order; groups without a row stay, with 0."""
    domain = spark.createDataFrame([("MACHINERY", 1), ("NO SUCH SEGMENT", 2), ("BUILDING", 3)], "segment string, pos int")
    counts = units_table(spark, sf).groupBy("segment").agg(F.count("unit_id").alias("n"))
    return domain.join(counts, "segment", "left").select("segment", F.coalesce("n", F.lit(0)).alias("n"), "pos").orderBy("pos")


@register("e23_transposed_rates", sql=with_units(rsql("""
    SELECT area, 'rate' AS measure, avg(target) AS value FROM units WHERE area IS NOT NULL GROUP BY area
    UNION ALL SELECT area, 'n', CAST(count(*) AS DOUBLE) FROM units WHERE area IS NOT NULL GROUP BY area""", r6="value")))
def e23_transposed_rates(spark, sf):
    wide = units_table(spark, sf).where("area IS NOT NULL").groupBy("area").agg(F.avg("target").alias("rate"), F.count(F.lit(1)).cast("double").alias("n"))
    return rounded(melt(wide, ["area"], ["rate", "n"], "measure", "value"))
