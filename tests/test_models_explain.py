"""Tree attributions, the Gini stump, chi-square and the PR curve against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from budgetlens.operators import baselines as BL
from budgetlens.operators import boosting as B
from budgetlens.operators import cluster as C
from budgetlens.operators import explain as X
from budgetlens.operators import metrics as M
from budgetlens.operators import tree_shap as TS


@pytest.fixture(scope="module")
def gbt(spark):
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 4))
    y = ((x[:, 0] + 0.5 * x[:, 1] * x[:, 2] + rng.normal(scale=0.5, size=n)) > 0).astype(float)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(label=y, id=range(n))
    df = VectorAssembler(inputCols=list("abcd"), outputCol="features").transform(spark.createDataFrame(pdf))
    model = GBTClassifier(maxIter=8, maxDepth=3, seed=1).fit(df)
    return df, model


def test_attributions_add_up_to_log_odds(spark, gbt):
    df, model = gbt
    phi = X.attributions(df, model, spark, list("abcd"), "id")
    bias = X.expected_value(X.tree_leaves(model, spark))
    err = X.additivity_error(phi, model.transform(df), bias, "id").first()["max_abs_error"]
    assert err < 1e-9


def test_interactions_sum_to_attributions(spark, gbt):
    df, model = gbt
    small = df.limit(60)
    phi = X.attributions(small, model, spark, list("abcd"), "id").toPandas()
    inter = X.interactions(small, model, spark, list("abcd"), "id").toPandas()
    # sum_j Phi_ij = phi_i, with each off-diagonal pair stored once
    rows = []
    for _, r in inter.iterrows():
        rows.append((r.id, r.f1, r.value))
        if r.f1 != r.f2:
            rows.append((r.id, r.f2, r.value))
    tot = pd.DataFrame(rows, columns=["id", "feature", "v"]).groupby(["id", "feature"]).v.sum()
    p = phi.set_index(["id", "feature"]).phi
    both = pd.concat([p, tot], axis=1).fillna(0.0)
    assert (both.iloc[:, 0] - both.iloc[:, 1]).abs().max() < 1e-9


def _as_leaves(table):
    """A path table as the leaves of the subset formula; bins are its thresholds."""
    out = []
    for k, v in enumerate(table.value):
        path = {int(f): (a, b, z) for f, a, b, z in zip(table.column[k], table.low[k], table.high[k], table.cover[k]) if (a, b, z) != (-1, 255, 1.0)}
        conds = [(f, a, False) for f, (a, _, _) in path.items()] + [(f, b, True) for f, (_, b, _) in path.items()]
        out.append(X.Leaf(float(v) / X.LOGODDS, tuple(sorted(path)), tuple(conds), tuple(path[f][2] for f in sorted(path))))
    return out


@pytest.mark.parametrize("depth", [1, 4, 10])
def test_quadrature_attributions_equal_the_subset_formula(spark, gbt, depth):
    df, _ = gbt
    wide = df.select("id", "label", *"abcd", *[(F.col(c) * F.col(d)).alias(c + d) for c, d in ("ab", "cd", "ad", "bc", "ac", "bd")])
    names = [c for c in wide.columns if c not in ("id", "label")]
    model = B.fit(wide, B.TreeSpec(rounds=3, depth=depth, least_rows=2), names, "label", "id")
    codes = model.bins.codes(wide.toPandas()[names].to_numpy(float))[:60]
    tables = TS.path_tables(model)
    phi = TS.shap_values(codes, tables, len(names))
    assert np.abs(phi.sum(axis=1) + TS.bias(model, tables) - model.margin(codes)).max() < 1e-9
    both = TS.interaction_values(codes, tables, len(names))
    assert np.abs(both.sum(axis=2) - phi).max() < 1e-9 and np.allclose(both, both.transpose(0, 2, 1))
    if depth <= 4:
        main, pairs = X.interaction_batch(codes.astype(float), [(1.0, _as_leaves(t)) for t in tables])
        assert np.abs(X.shap_batch(codes.astype(float), [(1.0, _as_leaves(t)) for t in tables]) - phi).max() < 1e-9
        assert all(np.abs(both[:, i, j] - v).max() < 1e-9 for (i, j), v in pairs.items())
        assert np.abs(np.stack([both[:, i, i] for i in range(len(names))], axis=1) - main).max() < 1e-9
    scored = TS.margins(wide, model, names, "id")
    assert TS.additivity_error(TS.attributions(wide, model, names, "id"), scored, TS.bias(model, tables), "id").first().max_abs_error < 1e-9


def test_gini_stump_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, 300).astype(float)
    y = (x + rng.normal(scale=8, size=300) > 15).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    got = BL.gini_stump(df, "x", "y").first()
    vals = np.unique(x)
    best = None
    for a, b in zip(vals[:-1], vals[1:]):
        t = (a + b) / 2
        imp = 0.0
        for side in (x <= t, x > t):
            ys = y[side]
            p = ys.mean()
            imp += len(ys) * (1 - p * p - (1 - p) * (1 - p))
        if best is None or imp < best[0] - 1e-12:
            best = (imp, t)
    assert got["threshold"] == pytest.approx(best[1])
    assert got["share_above"] == pytest.approx((x > best[1]).mean())


def test_chi_square_and_cramers_v(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 3, 500)
    b = (a + rng.integers(0, 2, 500)) % 4
    df = spark.createDataFrame(pd.DataFrame({"a": a.astype(str), "b": b.astype(str)}))
    got = C.chi_square(df, "a", "b").first()
    ct = pd.crosstab(a, b).to_numpy().astype(float)
    e = ct.sum(1, keepdims=True) * ct.sum(0, keepdims=True) / ct.sum()
    chi2 = ((ct - e) ** 2 / e).sum()
    assert got["chi2"] == pytest.approx(chi2)
    assert got["dof"] == (ct.shape[0] - 1) * (ct.shape[1] - 1)
    assert got["cramers_v"] == pytest.approx(np.sqrt(chi2 / (ct.sum() * (min(ct.shape) - 1))))


@pytest.mark.parametrize("name", ["s", "p"])
def test_pr_curve_matches_manual(spark, name):
    y = [1, 0, 1, 1, 0, 0, 1, 0]
    s = [0.9, 0.8, 0.8, 0.6, 0.5, 0.3, 0.2, 0.1]
    df = spark.createDataFrame(pd.DataFrame({"y": y, name: s}))
    curve = M.pr_curve(df, "y", name).toPandas()
    pts = curve.dropna(subset=["threshold"]).sort_values("threshold")
    # every distinct threshold down to the first reaching full recall (0.2), then the (1, 0) end point
    assert list(pts.threshold) == [0.2, 0.3, 0.5, 0.6, 0.8, 0.9]
    row = pts[pts.threshold == 0.8].iloc[0]
    assert row.precision == pytest.approx(2 / 3) and row.recall == pytest.approx(0.5)
    end = curve[curve.threshold.isna()].iloc[0]
    assert (end.precision, end.recall) == (1.0, 0.0)


def test_rows_that_pass_the_same_tests_are_explained_once(monkeypatch):
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 3, (3000, 4)).astype(np.uint8)
    y = ((codes[:, 0] > 1) ^ (codes[:, 2] > 0) ^ (rng.random(3000) < 0.1)).astype(float)
    model = B.train(codes, y, np.arange(3000), B.Bins([np.array([0.0, 1.0])] * 4, [0.0] * 4), B.TreeSpec(rounds=6, depth=3))
    tables, read, parts = TS.path_tables(model), [], TS._parts
    with monkeypatch.context() as m:
        m.setattr(TS, "_parts", lambda c, t: read.append(len(c)) or parts(c, t))
        phi, both = TS.shap_values(codes, tables, 4), TS.interaction_values(codes, tables, 4)
        assert sum(read) <= 2 * 2 * 3**4 * len(tables)  # all 3,000 rows a tree before
    monkeypatch.setattr(TS, "TESTS", 0)  # every row by itself
    assert np.allclose(phi, TS.shap_values(codes, tables, 4), atol=1e-12) and np.allclose(both, TS.interaction_values(codes, tables, 4), atol=1e-12)
    assert np.allclose(both.sum(axis=2), phi, atol=1e-12)
    assert np.allclose(phi.sum(axis=1) + TS.bias(model, tables), model.margin(codes), atol=1e-10)
    assert TS.shap_values(codes[:0], tables, 4).shape == (0, 4)
