"""Additive tree explanations for MLlib gradient-boosted trees.

Attributions are path-dependent TreeSHAP values. For one leaf with path
features U (|U| = d), "follows the split" indicators o_f(x) and cover
fractions z_f, the leaf's expected value given known features S is
v * prod_{f in S} o_f * prod_{f not in S} z_f, so each Shapley value is an
exact finite sum over the subsets of U - at most 2^(d-1) terms per feature,
evaluated as numpy vector operations over a whole Arrow batch of rows
(``mapInPandas``). Interaction values use the same factorisation with
(o_i - z_i)(o_j - z_j). The model is a bounded object (trees x nodes) read
from its saved node table and broadcast once.

MLlib's GBT probability is 1 / (1 + exp(-2 F)); values are reported on the
log-odds scale 2 F so that sum(phi) + bias equals the model's log-odds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import combinations
from typing import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

LOGODDS = 2.0


@dataclass(frozen=True)
class Leaf:
    value: float
    feats: tuple[int, ...]
    conds: tuple[tuple[int, float, bool], ...]  # (feature, threshold, goes_left)
    z: tuple[float, ...]                          # cover fraction per feature in ``feats``


def tree_leaves(model, spark) -> list[tuple[float, list[Leaf]]]:
    """(tree weight, leaves) per tree, from the saved node table (size: trees x nodes)."""
    import uuid

    path = f"{checkpoint_dir(spark).rstrip('/')}/budgetlens/models/{uuid.uuid4().hex}"
    model.write().overwrite().save(path)
    rows = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect()
    by_tree: dict[int, dict[int, object]] = {}
    for r in rows:
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    weights = list(model.treeWeights)
    out = []
    for t, nodes in sorted(by_tree.items()):
        leaves: list[Leaf] = []

        def walk(nid, conds, zf):
            n = nodes[nid]
            if n["leftChild"] < 0:
                feats = tuple(sorted(zf))
                leaves.append(Leaf(float(n["prediction"]), feats, tuple(conds), tuple(zf[f] for f in feats)))
                return
            f, thr = int(n["featureIndex"]), float(n["leftCategoriesOrThreshold"][0])
            cover = float(n["impurityStats"][0])
            for child, left in ((n["leftChild"], True), (n["rightChild"], False)):
                frac = float(nodes[child]["impurityStats"][0]) / cover if cover > 0 else 0.0
                z2 = dict(zf)
                z2[f] = z2.get(f, 1.0) * frac
                walk(child, conds + [(f, thr, left)], z2)

        walk(0, [], {})
        out.append((weights[t], leaves))
    return out


def expected_value(trees) -> float:
    """Bias term: cover-weighted mean prediction of the ensemble (log-odds)."""
    return LOGODDS * sum(w * sum(lf.value * math.prod(lf.z) for lf in leaves) for w, leaves in trees)


def _weights(d: int) -> list[float]:
    return [math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)]


def _indicators(x: np.ndarray, leaf: Leaf) -> dict[int, np.ndarray]:
    o = {f: np.ones(len(x), dtype=bool) for f in leaf.feats}
    for f, thr, left in leaf.conds:
        o[f] &= (x[:, f] <= thr) if left else (x[:, f] > thr)
    return o


def shap_batch(x: np.ndarray, trees) -> np.ndarray:
    """n x p matrix of path-dependent SHAP values (log-odds)."""
    phi = np.zeros_like(x, dtype=float)
    for w, leaves in trees:
        for lf in leaves:
            d = len(lf.feats)
            if d == 0:
                continue
            o = {f: v.astype(float) for f, v in _indicators(x, lf).items()}
            z = dict(zip(lf.feats, lf.z))
            wt = _weights(d)
            scale = LOGODDS * w * lf.value
            for i in lf.feats:
                others = [f for f in lf.feats if f != i]
                acc = np.zeros(len(x))
                for s in range(len(others) + 1):
                    for S in combinations(others, s):
                        term = np.full(len(x), wt[s])
                        for f in others:
                            term = term * (o[f] if f in S else z[f])
                        acc += term
                phi[:, i] += scale * (o[i] - z[i]) * acc
    return phi


def interaction_batch(x: np.ndarray, trees) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
    """Main effects (n x p) and off-diagonal interaction values per feature pair i < j (log-odds)."""
    phi = shap_batch(x, trees)
    inter: dict[tuple[int, int], np.ndarray] = {}
    for w, leaves in trees:
        for lf in leaves:
            d = len(lf.feats)
            if d < 2:
                continue
            o = {f: v.astype(float) for f, v in _indicators(x, lf).items()}
            z = dict(zip(lf.feats, lf.z))
            scale = LOGODDS * w * lf.value
            for i, j in combinations(lf.feats, 2):
                others = [f for f in lf.feats if f not in (i, j)]
                acc = np.zeros(len(x))
                for s in range(len(others) + 1):
                    wgt = math.factorial(s) * math.factorial(d - s - 2) / (2 * math.factorial(d - 1))
                    for S in combinations(others, s):
                        term = np.full(len(x), wgt)
                        for f in others:
                            term = term * (o[f] if f in S else z[f])
                        acc += term
                inter.setdefault((i, j), np.zeros(len(x)))
                inter[(i, j)] += scale * (o[i] - z[i]) * (o[j] - z[j]) * acc
    main = phi.copy()
    for (i, j), v in inter.items():
        main[:, i] -= v  # each off-diagonal value already carries half of the pair's effect
        main[:, j] -= v
    return main, inter


def attributions(df: DataFrame, model, spark, names: Sequence[str], key: str, features_col: str = "features") -> DataFrame:
    """Long ``(key, feature, phi)`` for every row and every feature, zeros included (M3)."""
    trees = tree_leaves(model, spark)
    bc = spark.sparkContext.broadcast(trees)
    names = list(names)

    def run(batches):
        for b in batches:
            x = np.vstack(b["x"].to_numpy()) if len(b) else np.zeros((0, len(names)))
            phi = shap_batch(x, bc.value)
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(names)), "feature": np.tile(np.array(names, dtype=object), len(b)), "phi": phi.ravel()})

    src = df.select(key, vector_to_array(features_col).alias("x"))
    key_type = dict(df.dtypes)[key]
    return src.mapInPandas(run, f"{key} {key_type}, feature string, phi double")


def interactions(df: DataFrame, model, spark, names: Sequence[str], key: str, features_col: str = "features") -> DataFrame:
    """Long ``(key, f1, f2, value)``: main effects on the diagonal, pairs f1 < f2 off it (M7)."""
    trees = tree_leaves(model, spark)
    bc = spark.sparkContext.broadcast(trees)
    names = list(names)

    def run(batches):
        for b in batches:
            x = np.vstack(b["x"].to_numpy()) if len(b) else np.zeros((0, len(names)))
            main, inter = interaction_batch(x, bc.value)
            keys = b[key].to_numpy()
            parts = []
            r, c = np.nonzero(main)
            parts.append(pd.DataFrame({key: keys[r], "f1": np.array(names, dtype=object)[c], "f2": np.array(names, dtype=object)[c], "value": main[r, c]}))
            for (i, j), v in inter.items():
                nz = np.nonzero(v)[0]
                a, bb = sorted([names[i], names[j]])
                parts.append(pd.DataFrame({key: keys[nz], "f1": a, "f2": bb, "value": v[nz]}))
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({key: [], "f1": [], "f2": [], "value": []})

    src = df.select(key, vector_to_array(features_col).alias("x"))
    key_type = dict(df.dtypes)[key]
    return src.mapInPandas(run, f"{key} {key_type}, f1 string, f2 string, value double")


def interaction_totals(df: DataFrame, model, spark, names: Sequence[str], features_col: str = "features") -> DataFrame:
    """``(f1, f2, value)`` with the absolute values of ``interactions`` added up over all rows; a batch sends one row a pair."""
    bc = spark.sparkContext.broadcast(tree_leaves(model, spark))
    names = list(names)

    def run(batches):
        for b in batches:
            if not len(b):
                continue
            main, inter = interaction_batch(np.vstack(b["x"].to_numpy()), bc.value)
            rows = [(f, f, float(np.abs(main[:, i]).sum())) for i, f in enumerate(names)]
            rows += [(*sorted([names[i], names[j]]), float(np.abs(v).sum())) for (i, j), v in inter.items()]
            yield pd.DataFrame(rows, columns=["f1", "f2", "value"])

    return df.select(vector_to_array(features_col).alias("x")).mapInPandas(run, "f1 string, f2 string, value double")


def additivity_error(phi: DataFrame, scored: DataFrame, bias: float, key: str, raw_col: str = "rawPrediction") -> DataFrame:
    """max |sum(phi) + bias - model log-odds| (M4); MLlib raw prediction is [-F, F]."""
    s = phi.groupBy(key).agg(F.sum("phi").alias("_s"))
    lo = scored.select(key, (F.lit(LOGODDS) * vector_to_array(raw_col)[1]).alias("_m"))
    j = lo.join(s, key, "left")
    return j.agg(F.max(F.abs(F.coalesce(F.col("_s"), F.lit(0.0)) + F.lit(bias) - F.col("_m"))).alias("max_abs_error"),
                 F.count(F.lit(1)).alias("n"))


def global_importance(phi: DataFrame, n_rows: int) -> DataFrame:
    """Mean |phi| per feature over all rows (absent = 0), ranked (M5)."""
    return phi.groupBy("feature").agg((F.sum(F.abs("phi")) / F.lit(float(n_rows))).alias("mean_abs_phi"))


def group_shares(importance: DataFrame, groups: dict[str, Sequence[str]]) -> DataFrame:
    """Share of total importance per feature group (M6); the group map is a small literal table."""
    spark = importance.sparkSession
    dim = spark.createDataFrame([(f, g) for g, fs in groups.items() for f in fs], "feature string, grp string")
    j = importance.join(F.broadcast(dim), "feature")
    g = j.groupBy("grp").agg(F.sum("mean_abs_phi").alias("imp"))
    return g.select("grp", (F.col("imp") / F.sum("imp").over(Window.partitionBy())).alias("share"))


def interaction_summary(inter: DataFrame, n_rows: int, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Top pairs by mean |interaction| and the main vs interaction totals (M8)."""
    m = inter.groupBy("f1", "f2").agg((F.sum(F.abs("value")) / F.lit(float(n_rows))).alias("mean_abs"))
    pairs = m.filter(F.col("f1") < F.col("f2"))
    top = pairs.orderBy(F.col("mean_abs").desc(), "f1", "f2").limit(k)
    tot = m.agg(F.sum(F.when(F.col("f1") == F.col("f2"), F.col("mean_abs"))).alias("main"),
                (2 * F.sum(F.when(F.col("f1") < F.col("f2"), F.col("mean_abs")))).alias("interactions"))
    tot = tot.withColumn("interaction_share", F.col("interactions") / (F.col("main") + F.col("interactions")))
    return top, tot


def top_contributions(phi: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Top-k contributions per row by |phi| with direction."""
    w = Window.partitionBy(key).orderBy(F.abs("phi").desc(), F.col("feature"))
    return phi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn(
        "direction", F.when(F.col("phi") > 0, F.lit("toward on track")).otherwise(F.lit("toward not on track")))


def coefficient_stability(coefs: DataFrame) -> DataFrame:
    """Per feature over parts: mean, sd, sd/|mean|, sign flip (M1, M2)."""
    return coefs.groupBy("feature").agg(
        F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("sd"),
        (F.max(F.col("coef") > 0).cast("int") * F.max(F.col("coef") < 0).cast("int")).alias("flips_sign"),
    ).withColumn("sd_over_abs_mean", F.try_divide(F.col("sd"), F.abs(F.col("mean"))))
