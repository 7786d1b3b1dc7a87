"""Explanation queries on the tuned boosted-tree model (rows-only checks): M1-M10."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..constants import SEED, TOP_CONTRIBUTIONS
from ..operators import binning as BN
from ..operators import boosting as B
from ..operators import explain as X
from ..operators import models as MD
from ..operators import tree_shap as TS
from ..operators.linear import fit_linear
from ..operators.splits import disjoint_parts
from ..spec import SHARES
from .common import rounded
from .q_models import feature_frame
from .registry import memo_result, register
from .tables import fingerprint

_FITTED: dict = {}


def fitted(spark, sf):
    """Tuned boosted trees fitted once per session on the training split: (model, feature columns, levels, test rows)."""
    key = (spark.sparkContext.applicationId, fingerprint(spark, sf))
    if key not in _FITTED:
        f, num, cat = feature_frame(spark, sf, holdout=True)
        train, columns, levels = MD.tree_frame(f.filter(F.col("is_test") == 0), num, cat)
        model = B.fit(train, MD.TUNED_BOOSTED.trees, columns, "target", "unit_id")
        test = MD.tree_frame(f.filter(F.col("is_test") == 1), num, cat, levels)[0].checkpoint()
        _FITTED[key] = (model, columns, levels, test)
    return _FITTED[key]


def _phi(spark, sf):
    model, columns, _, test = fitted(spark, sf)
    return TS.attributions(test, model, columns, "unit_id"), model, columns, test


@register("m03_attributions")
def m03_attributions(spark, sf):
    return rounded(_phi(spark, sf)[0])


@register("m04_additivity")
def m04_additivity(spark, sf):
    phi, model, columns, test = _phi(spark, sf)
    bias = TS.bias(model, TS.path_tables(model))
    return TS.additivity_error(phi, TS.margins(test, model, columns, "unit_id"), bias, "unit_id").withColumn("bias", F.lit(bias))


@register("m05_global_importance")
def m05_global_importance(spark, sf):
    phi, _, _, test = _phi(spark, sf)
    return rounded(X.global_importance(phi, test.count()).orderBy(F.col("mean_abs_phi").desc(), "feature").limit(20))


def feature_groups(columns, levels) -> dict[str, list[str]]:
    return {
        "income": ["log_income"], "spending mix": SHARES,
        "participation": [n for n in columns if n.startswith("spends_on_")],
        "debt": ["debt_to_income_w", "has_debt"], "composition": ["size", "dependents", "dependency_ratio"],
        "categorical": [f"{c}_{lv}" for c, found in levels.items() for lv in found],
    }


def raw_values(df, columns):
    """(unit_id, feature, value) of the model's features before imputation; 0/1 for category levels."""
    return df.select("unit_id", F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), B.column(n).cast("double").alias("value")) for n in columns])))


@register("m06_group_shares")
def m06_group_shares(spark, sf):
    phi, _, columns, test = _phi(spark, sf)
    return rounded(X.group_shares(X.global_importance(phi, test.count()), feature_groups(columns, fitted(spark, sf)[2])))


@register("m08_interaction_summary")
def m08_interaction_summary(spark, sf):
    model, columns, _, test = fitted(spark, sf)
    top, tot = X.interaction_summary(TS.interaction_totals(test, model, columns, "unit_id"), test.count())
    return rounded(top.unionByName(tot.select(F.lit("_total_main").alias("f1"), F.lit("").alias("f2"), F.col("main").alias("mean_abs")))
                   .unionByName(tot.select(F.lit("_total_interactions").alias("f1"), F.lit("").alias("f2"), F.col("interactions").alias("mean_abs")))
                   .unionByName(tot.select(F.lit("_interaction_share").alias("f1"), F.lit("").alias("f2"), F.col("interaction_share").alias("mean_abs"))))


@register("m09_row_explanations")
def m09_row_explanations(spark, sf):
    phi, model, columns, test = _phi(spark, sf)
    p = TS.margins(test, model, columns, "unit_id").select("unit_id", "p")
    pick = p.agg(F.min_by("unit_id", F.struct(-F.col("p"), F.col("unit_id"))).alias("most_confident_yes"),
                 F.min_by("unit_id", F.struct(F.col("p"), F.col("unit_id"))).alias("most_confident_no"),
                 F.min_by("unit_id", F.struct(F.abs(F.col("p") - 0.5), F.col("unit_id"))).alias("borderline"))
    cases = pick.unpivot([], ["most_confident_yes", "most_confident_no", "borderline"], "case", "unit_id")
    top = X.top_contributions(phi.join(F.broadcast(cases), "unit_id"), "unit_id", TOP_CONTRIBUTIONS)
    return rounded(top.join(p, "unit_id").join(raw_values(test, columns), ["unit_id", "feature"], "left"))


@register("m10_dependence_income_by_area")
def m10_dependence_income_by_area(spark, sf):
    phi, _, _, test = _phi(spark, sf)
    inc = phi.filter(F.col("feature") == "log_income").select("unit_id", "phi")
    raw = BN.with_quantile_bins(test.select("unit_id", "log_income", "area"), "log_income", 10, "bin")
    j = raw.join(inc, "unit_id", "left").fillna({"phi": 0.0})
    return rounded(j.groupBy("bin", "area").agg(F.avg("phi").alias("mean_phi"), F.count(F.lit(1)).alias("n")))


def _coefs(spark, sf, drop: str | None):
    f, num, cat = feature_frame(spark, sf, holdout=True)
    train = disjoint_parts(f.filter(F.col("is_test") == 0), "unit_id", 5, SEED)
    pre = MD.fit_preprocessor(train, num, cat, "robust")
    names = pre.names
    enc = pre.transform(train.withColumn("label", F.col("target").cast("double"))).checkpoint()

    def one(part):
        d = enc.filter(F.col("part") == part)
        d = MD._balanced_weights(d, "label")
        if drop:
            from pyspark.ml.feature import VectorSlicer

            keep = [i for i, nm in enumerate(names) if nm != drop]
            d = VectorSlicer(inputCol="features", outputCol="f2", indices=keep).transform(d).drop("features").withColumnRenamed("f2", "features")
            used = [names[i] for i in keep]
        else:
            used = names
        m = fit_linear(d, 100.0, weight="_w")
        return [(part, nm, float(c)) for nm, c in zip(used, m.coef)]

    with ThreadPoolExecutor(max_workers=5) as ex:  # the parts are independent
        rows = [r for found in ex.map(one, range(1, 6)) for r in found]
    return spark.createDataFrame(rows, "part int, feature string, coef double")


@register("m01_coefficient_stability")
def m01_coefficient_stability(spark, sf):
    return rounded(X.coefficient_stability(_coefs_all(spark, sf)))


_coefs_all = memo_result(lambda spark, sf: _coefs(spark, sf, None))
_coefs_all.__name__ = "coefs_all"


@register("m01_flips_by_group")
def m01_flips_by_group(spark, sf):
    """Per feature group: features, how many change sign between parts, median relative spread (M1)."""
    stable = X.coefficient_stability(_coefs_all(spark, sf))
    group = F.when(F.col("feature") == "log_income", "income").when(F.col("feature").endswith("_share"), "spending mix") \
        .when(F.col("feature").startswith("spends_on_"), "participation").when(F.col("feature").isin("debt_to_income_w", "has_debt"), "debt") \
        .when(F.col("feature").isin("size", "dependents", "dependency_ratio"), "composition").otherwise("categorical")
    return rounded(stable.groupBy(group.alias("grp")).agg(
        F.count(F.lit(1)).alias("features"), F.sum("flips_sign").alias("flips"), F.median("sd_over_abs_mean").alias("median_spread")))  # one row a feature


@register("m02_reference_part_refit")
def m02_reference_part_refit(spark, sf):
    full = X.coefficient_stability(_coefs_all(spark, sf)).select("feature", F.col("sd").alias("sd_all"))
    red = X.coefficient_stability(_coefs(spark, sf, "groceries_share")).select("feature", F.col("sd").alias("sd_dropped"))
    j = full.join(red, "feature").filter(F.col("feature").endswith("_share"))
    j = j.withColumn("improvement", F.col("sd_all") / F.col("sd_dropped"))
    return rounded(j.withColumn("median_improvement", F.median("improvement").over(Window.partitionBy())))  # one row a share
