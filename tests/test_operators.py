"""Invariants and edge cases of the operators (the study's printed identities, asserted)."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from budgetlens.functions.columns import argmax_label, lookup, nz_sum, to_double
from budgetlens.operators import binning as BN
from budgetlens.operators import cluster as C
from budgetlens.operators import ingest, metrics as M, simplex as SX, targeting as T
from budgetlens.operators.roles import ColumnRoles


def test_ilr_is_an_isometry_of_clr(spark):
    rng = np.random.default_rng(1)
    for d in (2, 3, 6, 11):
        x = rng.normal(size=(6, d))
        x -= x.mean(axis=1, keepdims=True)
        cols = [f"c{k}" for k in range(d)]
        y = np.array(spark.createDataFrame(x.tolist(), cols).select(*SX.ilr(cols)).collect())
        assert y.shape == (6, d - 1) and np.abs(x @ x.T - y @ y.T).max() < 1e-12


def test_zero_replacement_clr_and_all_zero_row(spark):
    rows = [(1, 0.5, 0.5, 0.0), (2, 0.2, 0.3, 0.5), (3, 0.0, 0.0, 0.0), (4, 0.1, 0.0, 0.9)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double")
    cols = ["a", "b", "c"]
    fit = SX.fit_zero_replacement(df, cols)
    assert fit.deltas["a"] == pytest.approx(0.65 * 0.1) and fit.deltas["c"] == pytest.approx(0.65 * 0.5)
    zr = df.select("id", *SX.zero_replaced(cols, fit))
    clr = zr.select("id", *SX.clr([f"{c}_zr" for c in cols], [f"{c}_clr" for c in cols])).toPandas().set_index("id")
    zrp = zr.toPandas().set_index("id")
    assert zrp.loc[[1, 2, 4]].sum(axis=1).round(12).eq(1.0).all()  # closed rows still sum to 1
    assert clr.loc[3].isna().all()  # all-zero core: undefined
    assert clr.loc[[1, 2, 4]].sum(axis=1).abs().max() < 1e-12


def test_ilr_is_an_isometry(spark):
    rng = np.random.default_rng(3)
    x = rng.dirichlet(np.ones(5), size=50)
    clr = np.log(x) - np.log(x).mean(axis=1, keepdims=True)
    df = spark.createDataFrame(pd.DataFrame(clr, columns=[f"c{i}" for i in range(5)]).assign(id=range(50)))
    il = df.select("id", *[F.col(f"c{i}") for i in range(5)], *SX.ilr([f"c{i}" for i in range(5)])).toPandas()
    a, b = il.iloc[:25], il.iloc[25:]
    d1 = np.linalg.norm(a[[f"c{i}" for i in range(5)]].values - b[[f"c{i}" for i in range(5)]].values, axis=1)
    d2 = np.linalg.norm(a[[f"ilr_{i}" for i in range(1, 5)]].values - b[[f"ilr_{i}" for i in range(1, 5)]].values, axis=1)
    assert np.abs(d1 - d2).max() < 1e-12


def test_coercion_and_lookup(spark):
    df = spark.createDataFrame([("1.5",), ("NA",), ("NaN",), ("abc",), (None,)], "x string")
    vals = [r[0] for r in df.select(to_double("x")).collect()]
    assert vals[0] == 1.5 and all(v is None for v in vals[1:])
    codes = spark.createDataFrame([(1,), (7,)], "c int")
    assert [r[0] for r in codes.select(lookup("c", {1: "one"})).collect()] == ["one", None]


def test_argmax_first_wins_and_default(spark):
    df = spark.createDataFrame([(2, 2, 1), (0, 3, 3), (0, 0, 0)], "a int, b int, c int")
    got = [r[0] for r in df.select(argmax_label(["a", "b", "c"], ["A", "B", "C"], "none")).collect()]
    assert got == ["A", "B", "none"]


def test_scan_contract_and_coercion(spark, tmp_path):
    p = tmp_path / "raw.tsv"
    p.write_text("id\tx\ty\n1\t2.5\tNA\n2\tNaN\t3\n")
    df = ingest.scan_delimited(spark, str(p), ["id", "x", "y"])
    assert df.collect()[0]["y"] is None and df.collect()[1]["x"] is None
    with pytest.raises(KeyError, match=r"\['z'\]"):
        ingest.scan_delimited(spark, str(p), ["id", "z"])


def test_nz_sum_all_null_is_zero(spark):
    df = spark.createDataFrame([(None, None)], "a double, b double")
    assert df.select(nz_sum(["a", "b"])).first()[0] == 0.0


def test_auc_with_ties_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = rng.integers(0, 10, 400) / 10.0  # heavy ties, includes 0
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pos, neg = s[y == 1], s[y == 0]
    brute = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert M.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute, abs=1e-12)


def test_calibration_drops_zero_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0, 0), (0.05, 0), (0.5, 1), (0.95, 1), (1.0, 1)], "p double, y int")
    cal = {r["bin"]: r["n"] for r in M.calibration(df, "p", "y").collect()}
    assert cal == {0: 1, 4: 1, 9: 2}  # p = 0 falls out, 0.5 is in (0.4, 0.5]


def test_top_fraction_with_hot_tied_score(spark):
    rng = np.random.default_rng(7)
    n = 3000
    score = rng.random(n).round(3)
    score[: n // 3] = 0.5  # a third of all units share one score
    y = rng.integers(0, 2, n)
    pdf = pd.DataFrame({"strategy": "s", "unit_id": rng.permutation(n), "score": score, "y": y})
    df = spark.createDataFrame(pdf)
    fr = [0.1, 0.25, 0.5, 0.9]
    got = {r["fraction"]: r["hits"] for r in T.top_fraction_hits(df, "strategy", "score", "unit_id", "y", fr).collect()}
    srt = pdf.sort_values(["score", "unit_id"], ascending=[False, True])
    for f in fr:
        assert got[f] == srt.y.iloc[: math.floor(n * f)].sum()


def test_quantile_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]], "x double")
    edges = BN.fit_quantile_edges(df, "x", 2)
    got = [r[0] for r in df.select(BN.quantile_bin("x", edges)).collect()]
    assert got == list(pd.qcut([1, 1, 1, 1, 2, 3, 4, 5, 6, 7], 2, labels=False))


def test_ari_identical_labelings(spark):
    df = spark.createDataFrame([(i % 3, i % 3) for i in range(30)], "a int, b int")
    assert C.adjusted_rand(df, "a", "b").first()[0] == pytest.approx(1.0)


def test_roles_guard():
    roles = ColumnRoles(identifier=("id",), target=("y",), leakage=("spend",))
    roles.assert_safe(["x"])
    with pytest.raises(ValueError):
        roles.assert_safe(["x", "spend"])
