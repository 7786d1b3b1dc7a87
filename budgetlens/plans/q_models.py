"""Training queries (rows-only checks): L4-L18, J5, J12, H9, P12."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import SEED
from ..operators import binning as BN
from ..operators import metrics as M
from ..operators import models as MD
from ..operators.boosting import TreeSpec
from ..operators.splits import stratified_folds, stratified_holdout
from ..spec import CATEGORICALS, PARTS, SHARES
from .common import rounded
from .registry import memo_result, register
from .tables import features_table, units_table

NON_FEATURES = {"unit_id", "weight", "income", "has_flag", "target", "rate", "fold", "is_test"}


def feature_frame(spark, sf, holdout: bool = False):
    """Feature table with fold ids (and the hold-out flag); numeric and categorical feature lists."""
    from ..operators.roles import select_by

    f = features_table(spark, sf)
    clr = select_by(f, suffix="_clr")
    num = select_by(f, exclude=[*NON_FEATURES, *CATEGORICALS, *clr])
    if holdout:
        f = stratified_holdout(f, "unit_id", "target")
    f = stratified_folds(f, "unit_id", "target", seed=SEED)
    # reliable checkpoint in spark.checkpoint.dir: every fit below reads it instead of recomputing folds
    return f.checkpoint(), num, list(CATEGORICALS)


@register("j05_preprocessor_names")
def j05_preprocessor_names(spark, sf):
    f, num, cat = feature_frame(spark, sf)
    pre = MD.fit_preprocessor(f, num, cat, "robust")
    enc = pre.transform(f).select("unit_id", "features")
    from pyspark.ml.functions import vector_to_array

    return enc.select("unit_id", F.size(vector_to_array("features")).alias("width")).withColumn(
        "names", F.lit(",".join(pre.names)))


@register("l04_depth3_tree_income")
def l04_depth3_tree_income(spark, sf):
    f, _, _ = feature_frame(spark, sf)
    spec = MD.ModelSpec("income_depth3_tree", "trees", trees=TreeSpec(kind="tree", rounds=1, depth=3))
    return rounded(MD.cross_validate(f, spec, ["log_income"], [], "target", "unit_id"))


# fixed values: the nested feature sets of the feature progression
PROGRESSION = {
    "1 column": ["log_income"],
    "2 columns": ["log_income", "groceries_share"],
    "3 columns": ["log_income", "groceries_share", "spends_on_insurance"],
}


@register("l06_feature_progression")
def l06_feature_progression(spark, sf):
    f, num, cat = feature_frame(spark, sf)
    rows, pres = None, MD.fold_preprocessors(f, num, cat, "robust")
    for step, (label, cols) in enumerate([*PROGRESSION.items(), ("every column", None)]):
        spec = MD.ModelSpec(label, "lr", {"C": 1.0}, balanced=True)
        r = MD.cross_validate(f, spec, cols or num, [] if cols else cat, "target", "unit_id", pres=pres)
        r = r.groupBy("model").agg(*[F.avg(m).alias(m) for m in ("accuracy", "precision", "recall", "f1_macro", "roc_auc")]).withColumn("step", F.lit(step))
        rows = r if rows is None else rows.unionByName(r)
    return rounded(BN.diff_previous(rows, "step", "roc_auc", "roc_auc_gain"))


@register("l12_model_comparison")
def l12_model_comparison(spark, sf):
    f, num, cat = feature_frame(spark, sf, holdout=True)
    train = f.filter(F.col("is_test") == 0)
    return rounded(MD.compare_models(train, MD.MODEL_SPECS, num, cat, "target", "unit_id"))


def _family(name: str, spec: MD.ModelSpec) -> None:
    """One query a model family: metrics of each fold of the training split."""
    def run(spark, sf):
        f, num, cat = feature_frame(spark, sf, holdout=True)
        return rounded(MD.cross_validate(f.filter(F.col("is_test") == 0), spec, num, cat, "target", "unit_id"))

    run.__name__ = name
    register(name)(run)


for _id, _spec in zip(("l01_majority", "l05_logistic_regression", "l07_linear_svm", "l08_decision_tree", "l09_random_forest", "l10_hist_boosting", "l11_boosted_trees"), MD.MODEL_SPECS, strict=True):
    if _id != "l01_majority":  # l01 has its own query
        _family(f"{_id}_folds", _spec)
_family("l09_small_forest_folds", MD.SMALL_FOREST)
_family("l11_tuned_boosted_trees_folds", MD.TUNED_BOOSTED)


@register("l15_lr_c_grid")
@memo_result
def l15_lr_c_grid(spark, sf):
    f, num, cat = feature_frame(spark, sf, holdout=True)
    train = f.filter(F.col("is_test") == 0)
    base = MD.ModelSpec("lr", "lr", {}, balanced=True)
    return rounded(MD.random_search(train, base, {"C": MD.LR_GRID}, 5, num, cat, "target", "unit_id"))


@register("l14_random_search")
@memo_result
def l14_random_search(spark, sf):
    """The study's search: 15 seeded draws over five parameters of boosted trees, each cross-validated."""
    f, num, cat = feature_frame(spark, sf, holdout=True)
    base = MD.ModelSpec("boosted_trees", "trees", trees=TreeSpec(l2=1.0))
    return rounded(MD.random_search(f.filter(F.col("is_test") == 0), base, MD.SEARCH_SPACE, 15, num, cat, "target", "unit_id"))


@register("l18_holdout_report")
def l18_holdout_report(spark, sf):
    f, num, cat = feature_frame(spark, sf, holdout=True)
    pred = MD.holdout_evaluation(f, MD.TUNED_BOOSTED, num, cat, "target", "unit_id")
    return rounded(M.classification_report(pred, "label", "pred"))


_BASE = [*SHARES, "log_income", "size", "dependents"]
_FOREST = MD.SMALL_FOREST


def _ablation(f, cat, variants: dict, families=("logistic", "forest"), scaler: str | None = "standard", pres: dict | None = None):
    """(variant, model, roc_auc, f1_macro) of the same scorers over feature sets; the logistic fits of all sets share each fold's preprocessing."""
    out = None
    if pres is None and "logistic" in families and len(variants) > 1:
        pres = MD.fold_preprocessors(f, list(dict.fromkeys(c for cols in variants.values() for c in cols)), cat, scaler)
    for label, cols in variants.items():
        specs = {"logistic": MD.ModelSpec("logistic", "lr", {"C": 1.0}, balanced=True, scaler=scaler), "forest": _FOREST}
        for family in families:
            r = MD.cross_validate(f, specs[family], cols, cat, "target", "unit_id", pres=pres if family == "logistic" else None)
            r = r.agg(F.avg("roc_auc").alias("roc_auc"), F.avg("f1_macro").alias("f1_macro")).select(F.lit(label).alias("variant"), F.lit(family).alias("model"), "roc_auc", "f1_macro")
            out = r if out is None else out.unionByName(r)
    return out


def _flags(f):
    return [c for c in f.columns if c.startswith("spends_on_")]


@register("j12_ablation_indicators")
def j12_ablation_indicators(spark, sf):
    f, _, cat = feature_frame(spark, sf)
    r = _ablation(f, cat, {"shares only": _BASE, "shares + participation": _BASE + _flags(f)}, ("logistic",))
    return rounded(r.select(F.col("variant").alias("model"), "roc_auc", "f1_macro"))


@register("j12_ablation_debt")
def j12_ablation_debt(spark, sf):
    """Debt as it is, winsorised, or as log1p, with the has-debt flag."""
    f, _, cat = feature_frame(spark, sf)
    raw = units_table(spark, sf).select("unit_id", "debt_to_income", F.log1p(F.greatest("debt_to_income", F.lit(0))).alias("log_debt_to_income"))
    f = f.join(raw, "unit_id").checkpoint()
    return rounded(_ablation(f, cat, {v: [*_BASE, *_flags(f), v, "has_debt"] for v in ("debt_to_income", "debt_to_income_w", "log_debt_to_income")}))


@register("j12_ablation_log_ratios")
def j12_ablation_log_ratios(spark, sf):
    """Raw shares against log-ratios of the core parts beside the zero-inflated shares."""
    f, _, cat = feature_frame(spark, sf)
    clr = [c for c in f.columns if c.endswith("_clr")]
    f = f.na.drop(subset=clr)
    core = {f"{c.removesuffix('_clr')}_share" for c in clr}
    rest = [*_flags(f), "debt_to_income_w", "has_debt"]
    return rounded(_ablation(f, cat, {"raw shares": _BASE + rest, "core log-ratios": [c for c in _BASE if c not in core] + clr + rest}))


@register("j12_ablation_scalers")
def j12_ablation_scalers(spark, sf):
    """No scaling, standard or robust scaling of the same features (J12); trees don't see the difference, so the forest runs once."""
    f, num, cat = feature_frame(spark, sf)
    out = _ablation(f, cat, {"any": num}, ("forest",))
    for name in (None, "standard", "robust"):
        out = out.unionByName(_ablation(f, cat, {name or "none": num}, ("logistic",), name))
    return rounded(out)


@register("j12_ablation_categories")
def j12_ablation_categories(spark, sf):
    """Features with and without each categorical column."""
    f, num, cat = feature_frame(spark, sf)
    pres = MD.fold_preprocessors(f, num, cat, "standard")
    out = _ablation(f, cat, {"all categories": num}, ("logistic",), pres=pres)
    for c in cat:
        out = out.unionByName(_ablation(f, [x for x in cat if x != c], {f"without {c}": num}, ("logistic",), pres=pres))
    return rounded(out.unionByName(_ablation(f, [], {"no categories": num}, ("logistic",), pres=pres)))


def _representation_frame(spark, sf):
    u = units_table(spark, sf).filter(F.col("has_flag").isNotNull())
    ratios = [F.try_divide(F.col(p), F.col("income")).alias(f"{p}_ratio") for p in PARTS]
    return u.select("*", *ratios), {"raw": PARTS, "ratio": [f"{p}_ratio" for p in PARTS], "shares": SHARES}


@register("h09_representation_transfer")
def h09_representation_transfer(spark, sf):
    """Fit on one half of the incomes, score the other, per representation; AUC of both directions and their mean (H9)."""
    u, reps = _representation_frame(spark, sf)
    long = MD.transfer_test(BN.median_split(u, "income", "low"), reps, "has_flag", "unit_id", "low")
    wide = long.groupBy("representation").pivot("transfer", ["low_to_high", "high_to_low"]).agg(F.first("roc_auc"))
    return rounded(wide.withColumn("mean", (F.col("low_to_high") + F.col("high_to_low")) / 2))


@register("h09_representation_same_distribution")
def h09_representation_same_distribution(spark, sf):
    """Cross-validated AUC and macro-F1 of each representation with all income levels mixed (H9)."""
    u, reps = _representation_frame(spark, sf)
    f, out = stratified_folds(u, "unit_id", "has_flag", seed=SEED).checkpoint(), None
    for name, cols in reps.items():
        r = MD.cross_validate(f, MD.ModelSpec(name, "lr", {"C": 1.0}, scaler="standard"), cols, [], "has_flag", "unit_id")
        r = r.groupBy(F.col("model").alias("representation")).agg(F.avg("roc_auc").alias("roc_auc"), F.avg("f1_macro").alias("f1_macro"))
        out = r if out is None else out.unionByName(r)
    return rounded(out)


def oof_scores(spark, sf):
    """Out-of-fold tuned boosted-tree probability for every unit."""
    f, num, cat = feature_frame(spark, sf)
    oof = MD.out_of_fold(f, MD.TUNED_BOOSTED, num, cat, "target", "unit_id")
    return oof


@register("p12_batch_scores")
def p12_batch_scores(spark, sf):
    oof = oof_scores(spark, sf)
    u = units_table(spark, sf).select("unit_id", "income")
    s = oof.join(u, "unit_id").select("unit_id", "label", "p", (1 - F.col("p")).alias("risk_score"), "income")
    s = BN.with_quantile_bins(s, "income", 10, "decile")
    return rounded(s.drop("income"))


@register("l16_c_sensitivity")
def l16_c_sensitivity(spark, sf):
    """Spread (sample sd) across the C levels of the mean CV macro-F1."""
    from ..operators.profile import spread_of_means

    grid = l15_lr_c_grid(spark, sf)
    return rounded(spread_of_means(grid, "C", "mean_f1"))


@register("l16_search_sensitivity")
def l16_search_sensitivity(spark, sf):
    """For each searched parameter, the sample sd of the mean score over its levels, largest first."""
    from ..operators.profile import spread_of_means

    draws, out = l14_random_search(spark, sf), None
    for name in MD.SEARCH_SPACE:
        one = spread_of_means(draws, name, "mean_f1").withColumn("parameter", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return rounded(out)
