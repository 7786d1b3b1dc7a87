"""Distributed Newton fits against scipy-free numpy solutions of the same objective."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from budgetlens.operators.linear import TOLERANCE, fit_linear


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 6))
    x[:, 3] *= 1e-4  # a column with hardly any spread, and a constant one
    x[:, 5] = 1.0
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=600) > 0.3).astype(int)
    s = np.where(y == 1, 600 / (2 * y.sum()), 600 / (2 * (600 - y.sum())))
    df = spark.createDataFrame([(Vectors.dense(a.tolist()), int(b), float(c)) for a, b, c in zip(x, y, s)], ["features", "label", "w"])
    return df.repartition(5), x, y, s


def objective(x, y, s, c, w, b, loss):
    m = (2 * y - 1) * (x @ w + b)
    value = np.logaddexp(0, -m) if loss == "log" else np.maximum(0, 1 - m) ** 2
    return 0.5 * (w @ w + (b * b if loss != "log" else 0)) + c * (s @ value)


@pytest.mark.parametrize("loss", ["log", "squared hinge"])
@pytest.mark.parametrize("c", [0.01, 1.0, 100.0])
def test_newton_reaches_the_optimum(rows, c, loss):
    df, x, y, s = rows
    m = fit_linear(df, c, loss, weight="w")
    assert m.gradient <= TOLERANCE and m.iterations < 40
    best = objective(x, y, s, c, m.coef, m.intercept, loss)
    rng = np.random.default_rng(1)
    for scale in (1e-3, 1e-1):
        for _ in range(20):  # convex: no nearby point is better
            d = rng.normal(size=7) * scale
            assert objective(x, y, s, c, m.coef + d[:-1], m.intercept + d[-1], loss) >= best
    assert best < objective(x, y, s, c, np.zeros(6), 0.0, loss)


def test_probability_column(rows):
    df, x, y, s = rows
    m = fit_linear(df, 1.0, weight="w")
    auc_like = df.select(m.probability().alias("p"), "label").groupBy("label").agg(F.avg("p").alias("p")).orderBy("label").collect()
    assert auc_like[1].p > auc_like[0].p + 0.2


def test_no_rows(spark, rows):
    with pytest.raises(ValueError):
        fit_linear(rows[0].limit(0), 1.0)


def test_shared_preprocessing_and_kept_rows_give_the_same_search(spark, monkeypatch):
    from budgetlens.operators import models as MD

    rng = np.random.default_rng(5)
    rows = [(i, float(a) if i % 9 else None, float(b), "xyz"[i % 3], int(a + b + rng.normal() > 0), i % 5) for i, (a, b) in enumerate(rng.normal(size=(200, 2)))]
    df = spark.createDataFrame(rows, "unit_id long, a double, b double, c string, target int, fold int").cache()
    spec = MD.ModelSpec("lr", "lr", {}, balanced=True)
    args = (["a", "b"], ["c"], "target", "unit_id")
    calls, fit = [], MD.fit_preprocessor
    monkeypatch.setattr(MD, "fit_preprocessor", lambda *a, **k: calls.append(1) or fit(*a, **k))
    got = {r.C: r.mean_f1 for r in MD.random_search(df, spec, {"C": [0.01, 1.0]}, 2, *args).collect()}
    assert len(calls) == 5  # one a fold, not one a fold and draw
    for c, f1 in got.items():
        alone = MD.cross_validate(df, MD.ModelSpec("lr", "lr", {"C": c}, balanced=True), *args)
        assert abs(np.mean([r.f1_macro for r in alone.collect()]) - f1) < 1e-12
    pres = MD.fold_preprocessors(df, ["a", "b"], ["c"], "robust")
    for num, cat in ((["b"], []), (["a", "b"], ["c"])):
        one, two = (sorted(MD.cross_validate(df, spec, num, cat, "target", "unit_id", pres=p).collect()) for p in (None, pres))
        assert one == two


def test_all_c_share_their_passes_and_slots_give_the_same_sums(rows, monkeypatch):
    from budgetlens.operators import linear as L

    df, x, y, s = rows
    calls, run = [], L._pass
    monkeypatch.setattr(L, "_pass", lambda *a: calls.append(len(a[2])) or run(*a))
    cs = [0.01, 1.0, 100.0]
    together = L.fit_linear_each(df, cs, weight="w")
    shared = len(calls)
    alone = [fit_linear(df, c, weight="w") for c in cs]
    assert calls[0] == 3 and shared < len(calls) - shared
    monkeypatch.setattr(L, "DIRECT_BYTES", 0)
    for one, two, three in zip(together, alone, L.fit_linear_each(df, cs, weight="w"), strict=True):
        assert np.allclose(one.coef, two.coef, atol=1e-9) and np.allclose(one.coef, three.coef, atol=1e-9)


def test_kept_rows_are_blocks_of_numbers(rows):
    from pyspark.ml.functions import vector_to_array

    from budgetlens.operators import linear as L

    df, x, y, s = rows
    flat = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("w").alias("s"), F.lit(3).alias("slot"))
    blocks = L._packed(flat).collect()
    assert len(blocks) == 5 and {b.slot for b in blocks} == {3}  # one a batch, not one a row
    got = np.concatenate([np.c_[np.frombuffer(b.x).reshape(-1, 6), np.frombuffer(b.y), np.frombuffer(b.s)] for b in blocks])
    want = np.c_[x, y, s]
    assert np.array_equal(got[np.lexsort(got.T)], want[np.lexsort(want.T)])
