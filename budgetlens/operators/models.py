"""Preprocessing pipelines, model families, cross-validation and search on MLlib.

Trees, forests and boosting are histogram trees (``boosting``), all folds and draws of a comparison trained at once; logistic
regression and the linear SVM are distributed Newton fits (``linear``). Their preprocessing
fits are exact aggregations (medians and IQRs by ``functions.quantiles``) fitted
on the training rows only and applied as literal projections; their folds run in parallel driver threads. Categories of
more than DENSE_LEVELS levels together go through ``sparse``: the same optimum without one column a level.
"""

from __future__ import annotations

import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Callable, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import N_FOLDS, SEED
from . import boosting as B
from . import features as FE
from . import sparse as SP
from .linear import fit_linear_each
from .metrics import classification_metrics, roc_auc

DENSE_LEVELS = 500  # with more levels a Hessian of 2 MB a slot would be exceeded


@dataclass(frozen=True)
class Preprocessor:
    """Median imputation + scaling for numeric columns, one-hot for categoricals."""
    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    medians: dict
    scale: FE.ScaleFit | None
    levels: dict

    @property
    def names(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{lv}" for c in self.categorical for lv in self.levels[c]]]

    def of(self, numeric: Sequence[str], categorical: Sequence[str]) -> "Preprocessor":
        """The same fit for some of the columns; every column is fitted by itself."""
        return replace(self, numeric=tuple(numeric), categorical=tuple(categorical))

    def numbers(self) -> Column:
        """The imputed and scaled numeric columns as one array, without the categories."""
        filled = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        if self.scale is not None:
            filled = {c: (x - F.lit(self.scale.center[c])) / F.lit(self.scale.scale[c]) for c, x in filled.items()}
        return F.array(*filled.values()).cast("array<double>")

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        num = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(f"__n_{c}") for c in self.numeric]
        d = df.select("*", *num)
        if self.scale is not None:
            d = d.select("*", *[((F.col(f"__n_{c}") - F.lit(self.scale.center[c])) / F.lit(self.scale.scale[c])).alias(f"__s_{c}")
                                for c in self.numeric])
            ncols = [f"__s_{c}" for c in self.numeric]
        else:
            ncols = [f"__n_{c}" for c in self.numeric]
        onehot = [F.coalesce((F.col(c) == F.lit(lv)).cast("double"), F.lit(0.0)).alias(f"__o_{c}_{lv}") for c in self.categorical for lv in self.levels[c]]
        d = d.select("*", *onehot)
        cols = ncols + [f"__o_{c}_{lv}" for c in self.categorical for lv in self.levels[c]]
        out_df = VectorAssembler(inputCols=cols, outputCol=out, handleInvalid="keep").transform(d)
        return out_df.drop(*[c for c in out_df.columns if c.startswith("__")])


def fit_preprocessor(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (),
                     scaler: str | None = "robust") -> Preprocessor:
    """Fit imputation, scaling and level lists on the training rows in as few passes as possible.

    One pass gives NULL counts and one the category levels; one exact-quantile pass gives
    medians and quartiles. Quartiles are refitted on imputed values only for the
    columns that actually had NULLs (imputation moves their quartiles).
    """
    from ..functions.quantiles import quantile_map

    numeric, categorical = list(numeric), list(categorical)
    first = train.agg(F.count("*"), *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
    levels = FE.fit_levels(train, categorical)
    has_null = [c for i, c in enumerate(numeric) if first[f"n{i}"] > 0]
    probs = [0.25, 0.5, 0.75] if scaler == "robust" else [0.5]
    q = quantile_map(train, numeric, probs) if numeric else {}
    med = {c: q.get((c, 0.5)) for c in numeric}
    sc = None
    if scaler == "robust" and numeric:
        if has_null:
            filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in has_null])
            q.update(quantile_map(filled, has_null, [0.25, 0.75]))
        center = {c: med[c] for c in numeric}
        scale = {}
        for c in numeric:
            iqr = (q[(c, 0.75)] - q[(c, 0.25)]) if q.get((c, 0.75)) is not None else 0.0
            scale[c] = iqr if iqr != 0 else 1.0
        sc = FE.ScaleFit(center, scale)
    elif scaler == "standard" and numeric:
        filled = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(med[c])).alias(c) for c in numeric])
        sc = FE.fit_standard_scaler(filled, numeric, ddof=0)
    return Preprocessor(tuple(numeric), tuple(categorical), med, sc, levels)


def fold_preprocessors(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], scaler: str | None, fold: str = "fold",
                       k: int = N_FOLDS) -> dict[int, Preprocessor] | None:
    """The preprocessing of every fold's training rows, for fits that share it; None if there are more levels than DENSE_LEVELS."""
    if FE.more_levels_than(df, categorical, DENSE_LEVELS):
        return None
    with ThreadPoolExecutor(max_workers=k) as ex:
        return dict(enumerate(ex.map(lambda i: fit_preprocessor(df.filter(F.col(fold) != i), numeric, categorical, scaler), range(k))))


# ---- model families
@dataclass(frozen=True)
class ModelSpec:
    name: str
    kind: str  # majority, lr, svm or trees
    params: dict = field(default_factory=dict)
    balanced: bool = False
    scaler: str | None = "robust"
    trees: B.TreeSpec | None = None


# fixed values: the study's model presets
MODEL_SPECS = [
    ModelSpec("majority", "majority"),
    ModelSpec("logistic_regression", "lr", {"C": 1.0}, balanced=True),
    ModelSpec("linear_svm", "svm", {"C": 1.0}, balanced=True),
    ModelSpec("decision_tree", "trees", trees=B.TreeSpec(kind="tree", rounds=1, depth=8, balanced=True)),
    ModelSpec("random_forest", "trees", trees=B.TreeSpec(kind="forest", rounds=300, least_rows=2, balanced=True)),
    ModelSpec("hist_boosting", "trees", trees=B.TreeSpec(rounds=100, rate=0.1, leaves=31, least_rows=20)),
    ModelSpec("boosted_trees", "trees", trees=B.TreeSpec(rounds=400, depth=6, rate=0.08, row_share=0.9, column_share=0.9, l2=1.0, least_hessian=1.0)),
]
TUNED_BOOSTED = ModelSpec("boosted_trees_tuned", "trees", trees=B.TreeSpec(rounds=200, depth=4, rate=0.15, row_share=0.9, l2=1.0, least_hessian=5.0))
SMALL_FOREST = ModelSpec("random_forest_150", "trees", trees=B.TreeSpec(kind="forest", rounds=150, least_rows=2, balanced=True))
SEARCH_SPACE = {
    "depth": [4, 6, 8, 10],
    "rate": [0.03, 0.08, 0.15],
    "rounds": [200, 400, 700],
    "row_share": [0.7, 0.9, 1.0],
    "least_hessian": [1, 5, 20],
}
LOSSES = {"lr": "log", "svm": "squared hinge"}
LR_GRID = [0.01, 0.1, 1.0, 10.0, 100.0]


def tree_frame(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], levels: dict | None = None) -> tuple[DataFrame, list[str], dict]:
    """``df`` with a 0/1 column for every level of ``categorical``; the feature columns; the levels. Unknown levels are all zeros."""
    levels = FE.fit_levels(df, categorical) if levels is None else levels
    names = {f"{c}_{lv}": F.coalesce((F.col(c) == F.lit(lv)).cast("double"), F.lit(0.0)) for c in categorical for lv in levels[c]}
    return df.select("*", *[e.alias(n) for n, e in names.items()]), [*numeric, *names], levels


def _tree_spec(spec: ModelSpec, columns: Sequence[str]) -> B.TreeSpec:
    """Forests draw the square root of the column count at every node."""
    return replace(spec.trees, node_columns=max(1, int(len(columns) ** 0.5))) if spec.trees.kind == "forest" else spec.trees


def tree_scores(df: DataFrame, specs: Sequence[ModelSpec], numeric, categorical, label: str, key: str, fold: str = "fold", k: int = N_FOLDS) -> DataFrame:
    """Out-of-fold (model, fold, k, label, p, pred) of tree models; all of them and all folds are trained together."""
    frame, columns, _ = tree_frame(df, numeric, categorical)
    scores = B.cross_scores(frame, {s.name: _tree_spec(s, columns) for s in specs}, columns, label, key, fold, k)
    return scores.withColumn("pred", (F.col("p") > 0.5).cast("int"))


def grouped_metrics(scores: DataFrame) -> DataFrame:
    """(model, fold, accuracy, f1_macro, precision, recall, roc_auc)."""
    by = ["model", "fold"]
    plain = classification_metrics(scores, "label", "pred", by).select(*by, "accuracy", "f1_macro", "precision", "recall")
    return plain.join(roc_auc(scores, "label", "p", by), by, "left")


def _balanced_weights(train: DataFrame, label: str) -> DataFrame:
    """Attach ``n / (2 n_c)`` weights."""
    counts = {r[0]: r[1] for r in train.groupBy(label).agg(F.count(F.lit(1))).collect()}  # two rows
    n = float(sum(counts.values()))
    k = len(counts)
    w = F.lit(None).cast("double")
    for cls, nc in counts.items():
        w = F.when(F.col(label) == cls, F.lit(n / (k * nc))).otherwise(w)
    return train.withColumn("_w", w)


def fit_predict(spec: ModelSpec, train: DataFrame, test: DataFrame, numeric, categorical, label: str, key: str,
                seed: int = SEED, pre: Preprocessor | None = None) -> DataFrame:
    """Fit preprocessing + model on ``train``; return ``(key, label, p, pred)`` for ``test``. ``pre``: linear preprocessing fitted on ``train`` before."""
    if spec.kind == "majority":
        pos, n = train.agg(F.sum(F.col(label).cast("long")), F.count(F.lit(1))).first()
        mode = 1 if pos * 2 > n else 0
        return test.select(key, F.col(label).alias("label"), F.lit(pos / n).alias("p"), F.lit(mode).alias("pred"))
    if spec.kind == "trees":
        own, columns, levels = tree_frame(train, numeric, categorical)
        model = B.fit(own, replace(_tree_spec(spec, columns), seed=seed), columns, label, key)
        out = B.predictions(tree_frame(test, numeric, categorical, levels)[0], model, columns, label, key)
        return out.select(key, "label", "p", (F.col("p") > 0.5).cast("int").alias("pred"))
    if spec.kind not in LOSSES:
        raise ValueError(spec.kind)
    if pre is None:
        if FE.more_levels_than(train, categorical, DENSE_LEVELS):
            return _sparse_fit_predict([spec], train, test, numeric, categorical, label, key)[0]
        pre = fit_preprocessor(train, numeric, categorical, spec.scaler)
    return _linear_predictions(spec, [spec.params.get("C", 1.0)], pre.of(numeric, categorical), train, test, label, key)[0]


def _linear_predictions(spec: ModelSpec, cs: Sequence[float], pre: Preprocessor, train: DataFrame, test: DataFrame, label: str, key: str) -> list[DataFrame]:
    """``(key, label, p, pred)`` of ``test`` for each C."""
    tr = pre.transform(train.withColumn("label", F.col(label).cast("double")))
    te = pre.transform(test.withColumn("label", F.col(label).cast("double")))
    wcol = None
    if spec.balanced:
        tr, wcol = _balanced_weights(tr, "label"), "_w"
    out = []
    for linear in fit_linear_each(tr, cs, LOSSES[spec.kind], weight=wcol):
        score = linear.probability() if spec.kind == "lr" else F.lit(None).cast("double")
        out.append(te.select(key, F.col("label").cast("int").alias("label"), score.alias("p"), (linear.margin() > 0).cast("int").alias("pred")))
    return out


def linear_predictions_each(specs: Sequence[ModelSpec], train: DataFrame, test: DataFrame, numeric, categorical, label: str, key: str) -> list[DataFrame]:
    """``fit_predict`` of linear models that share scaler and weights; over many levels they share preprocessing, level numbers and kept rows too."""
    if len({(s.scaler, s.balanced) for s in specs}) > 1 or any(s.kind not in LOSSES for s in specs):
        raise ValueError("linear models with one scaler and one kind of weights only")
    if specs and FE.more_levels_than(train, categorical, DENSE_LEVELS):
        return _sparse_fit_predict(specs, train, test, numeric, categorical, label, key)
    return [fit_predict(s, train, test, numeric, categorical, label, key) for s in specs]


def _sparse_fit_predict(specs: Sequence[ModelSpec], train: DataFrame, test: DataFrame, numeric, categorical, label: str, key: str) -> list[DataFrame]:
    """``fit_predict`` of linear models over categories with any number of levels."""
    pre = fit_preprocessor(train, numeric, [], specs[0].scaler)
    index = SP.index_levels(train, categorical)

    def rows(df: DataFrame) -> DataFrame:
        return SP.encode(df.select("*", pre.numbers().alias("_x"), F.col(label).cast("double").alias("_y")), index, "_levels").select(key, "_x", "_levels", "_y")

    tr, wcol = rows(train), None
    if specs[0].balanced:
        tr, wcol = _balanced_weights(tr, "_y"), "_w"
    models = SP.fit_sparse_each(tr, index.width, [(s.params.get("C", 1.0), LOSSES[s.kind]) for s in specs], "_x", "_levels", "_y", wcol)
    encoded, out = rows(test), []
    for spec, model in zip(specs, models, strict=True):
        scored = model.margin(encoded, "_x", "_levels", "_margin")
        p = 1 / (1 + F.exp(-F.col("_margin"))) if spec.kind == "lr" else F.lit(None).cast("double")
        out.append(scored.select(key, F.col("_y").cast("int").alias("label"), p.alias("p"), (F.col("_margin") > 0).cast("int").alias("pred")))
    return out


def fold_metrics(pred: DataFrame) -> DataFrame:
    """accuracy, f1_macro, precision, recall, roc_auc of one held-out fold."""
    m = classification_metrics(pred, "label", "pred")
    auc = roc_auc(pred.filter(F.col("p").isNotNull()), "label", "p")
    return m.unionByName(auc, allowMissingColumns=True).agg(
        *[F.max(c).alias(c) for c in ("accuracy", "f1_macro", "precision", "recall", "roc_auc")])


def cross_validate(df: DataFrame, spec: ModelSpec, numeric, categorical, label: str, key: str, fold: str = "fold",
                   k: int = N_FOLDS, parallelism: int = N_FOLDS, seed: int = SEED, pres: dict[int, Preprocessor] | None = None) -> DataFrame:
    """Per-fold metrics ``(model, fold, accuracy, f1_macro, precision, recall, roc_auc)`` (L12). ``pres``: ``fold_preprocessors`` of these columns at least."""
    if spec.kind == "trees":
        return grouped_metrics(tree_scores(df, [spec], numeric, categorical, label, key, fold, k))

    def one(i):
        pred = fit_predict(spec, df.filter(F.col(fold) != i), df.filter(F.col(fold) == i), numeric, categorical, label, key, seed, pres and pres[i])
        return [(spec.name, i, *[r for r in fold_metrics(pred).first()])]

    with ThreadPoolExecutor(max_workers=parallelism) as ex:
        rows = [r for part in ex.map(one, range(k)) for r in part]
    return df.sparkSession.createDataFrame(
        rows, "model string, fold int, accuracy double, f1_macro double, precision double, recall double, roc_auc double")


def out_of_fold(df: DataFrame, spec: ModelSpec, numeric, categorical, label: str, key: str, fold: str = "fold",
                k: int = N_FOLDS, seed: int = SEED) -> DataFrame:
    """Out-of-fold ``(key, label, p, pred)`` for every row: union of the held-out folds."""
    if spec.kind == "trees":
        scores = tree_scores(df, [spec], numeric, categorical, label, key, fold, k)
        return scores.select(F.col("k").cast(df.schema[key].dataType).alias(key), "label", "p", "pred")

    def one(i):
        pred = fit_predict(spec, df.filter(F.col(fold) != i), df.filter(F.col(fold) == i), numeric, categorical, label, key, seed)
        return pred.checkpoint()  # reliable checkpoint: a lost executor does not refit the fold

    with ThreadPoolExecutor(max_workers=k) as ex:
        parts = list(ex.map(one, range(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_models(df: DataFrame, specs: Sequence[ModelSpec], numeric, categorical, label: str, key: str) -> DataFrame:
    """Mean CV metrics per model and the F1 population sd, ranked by macro-F1 with the winner marked."""
    trees, other = [s for s in specs if s.kind == "trees"], [s for s in specs if s.kind != "trees"]
    # families are independent; two at a time (each runs its folds at once) keep the slots busy without a crowd of jobs
    with ThreadPoolExecutor(max_workers=2) as ex:
        parts = list(ex.map(lambda s: cross_validate(df, s, numeric, categorical, label, key), other))
    if trees:
        parts.append(grouped_metrics(tree_scores(df, trees, numeric, categorical, label, key)))
    per = parts[0]
    for r in parts[1:]:
        per = per.unionByName(r)
    out = per.groupBy("model").agg(
        F.avg("accuracy").alias("accuracy"), F.avg("f1_macro").alias("f1_macro"), F.avg("precision").alias("precision"),
        F.avg("recall").alias("recall"), F.stddev_pop("f1_macro").alias("f1_sd"), F.avg("roc_auc").alias("roc_auc"))
    rank = F.row_number().over(Window.orderBy(F.desc("f1_macro"), "model"))  # one row a model
    return out.withColumn("rank", rank).withColumn("winner", F.col("rank") == 1).orderBy("rank")


def random_search(df: DataFrame, base: ModelSpec, space: dict, n_iter: int, numeric, categorical, label: str, key: str,
                  seed: int = SEED) -> DataFrame:
    """Seeded draws from a parameter grid, each cross-validated; one row per draw."""
    rng = random.Random(seed)
    grid = [{}]
    for name, values in space.items():
        grid = [{**g, name: v} for g in grid for v in values]
    draws = rng.sample(grid, min(n_iter, len(grid)))
    cols = ", ".join(f"{n} double" for n in space)
    if base.kind == "trees":  # one fused training for all draws and folds
        drawn = [replace(base, name=str(i), trees=replace(base.trees, **params)) for i, params in enumerate(draws)]
        mean = grouped_metrics(tree_scores(df, drawn, numeric, categorical, label, key)).groupBy(F.col("model").cast("int").alias("draw")).agg(F.avg("f1_macro").alias("mean_f1"))
        table = df.sparkSession.createDataFrame([(i, *[float(params[n]) for n in space]) for i, params in enumerate(draws)], f"draw int, {cols}")
        return table.join(mean, "draw")

    pres = fold_preprocessors(df, numeric, categorical, base.scaler) if base.kind in LOSSES and set(space) <= {"C"} else None
    if pres:  # a fold's rows are prepared and kept once for all draws
        cs = [{**base.params, **params}.get("C", 1.0) for params in draws]

        def fold_f1(f):
            preds = _linear_predictions(base, cs, pres[f], df.filter(F.col("fold") != f), df.filter(F.col("fold") == f), label, key)
            return [(i, *[float(params.get(n, float("nan"))) for n in space], fold_metrics(p).first()["f1_macro"]) for i, (params, p) in enumerate(zip(draws, preds, strict=True))]

        with ThreadPoolExecutor(max_workers=N_FOLDS) as ex:
            rows = [r for part in ex.map(fold_f1, range(N_FOLDS)) for r in part]
        long = df.sparkSession.createDataFrame(rows, f"draw int, {cols}, f1 double")
        return long.groupBy("draw", *space).agg(F.avg("f1").alias("mean_f1"))

    def one(item):
        i, params = item
        spec = ModelSpec(f"{base.name}_{i}", base.kind, {**base.params, **params}, base.balanced, base.scaler)
        m = cross_validate(df, spec, numeric, categorical, label, key).agg(F.avg("f1_macro").alias("f1")).first()["f1"]
        return (i, *[float(params.get(n, float("nan"))) for n in space], float(m))

    # draws are independent: evaluate them concurrently (each one runs its folds concurrently too)
    with ThreadPoolExecutor(max_workers=max(1, min(len(draws), 5))) as ex:
        rows = list(ex.map(one, enumerate(draws)))
    return df.sparkSession.createDataFrame(rows, f"draw int, {cols}, mean_f1 double")


def holdout_evaluation(df: DataFrame, spec: ModelSpec, numeric, categorical, label: str, key: str,
                       test_flag: str = "is_test") -> DataFrame:
    """Fit on the training split once, evaluate on the held-out split once."""
    pred = fit_predict(spec, df.filter(F.col(test_flag) == 0), df.filter(F.col(test_flag) == 1), numeric, categorical,
                       label, key)
    return pred


def transfer_test(df: DataFrame, representations: dict, label: str, key: str, split_col: str) -> DataFrame:
    """Fit on one half, score the other, both directions, per representation; AUC (H9)."""
    rows = []
    for name, cols in representations.items():
        for direction, tr_v in (("low_to_high", 1), ("high_to_low", 0)):
            spec = ModelSpec(name, "lr", {"C": 1.0}, balanced=False, scaler="standard")
            pred = fit_predict(spec, df.filter(F.col(split_col) == tr_v), df.filter(F.col(split_col) != tr_v), cols, [],
                               label, key)
            auc = roc_auc(pred, "label", "p").first()["roc_auc"]
            rows.append((name, direction, float(auc) if auc is not None else None))
    return df.sparkSession.createDataFrame(rows, "representation string, transfer string, roc_auc double")
