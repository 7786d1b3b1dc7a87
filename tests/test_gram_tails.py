"""Gram correlations against pandas, chi-square tails against numerical integration."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from budgetlens.functions.tails import chi_square_tail, erfc
from budgetlens.operators.features import vif
from budgetlens.operators.gram import pair_correlations
from budgetlens.operators.profile import corr_matrix


def frame(n=500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 5))
    x[:, 1] = x[:, 0] * 2 + 0.1 * x[:, 1]
    x[:, 2] += 1e9  # a large offset
    x[:, 3] = 0.1  # constant
    pdf = pd.DataFrame(x, columns=["a", "b", "c d", "flat", "e.f"])
    pdf.loc[rng.random(n) < 0.3, "a"] = np.nan
    pdf.loc[rng.random(n) < 0.5, "e.f"] = np.nan
    return pdf


def as_nulls(spark, pdf):
    rows = [tuple(None if math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in pdf.columns)).repartition(6)


def test_pairwise_complete_correlations(spark):
    pdf = frame()
    cols = ["a", "b", "c d", "flat", "`e.f`"]
    got = pair_correlations(as_nulls(spark, pdf), cols)
    want = pdf.corr().to_numpy()
    want[3, :] = want[:, 3] = np.nan
    assert np.allclose(got, want, atol=1e-7, equal_nan=True)
    long = {(r.a, r.b): r.r for r in corr_matrix(as_nulls(spark, pdf), cols).collect()}
    assert len(long) == 25 and long[("flat", "flat")] == 1.0 and long[("a", "flat")] is None


def test_correlations_of_odd_tables(spark):
    df = as_nulls(spark, frame(40))
    assert np.isnan(pair_correlations(df.limit(0), ["a", "b"])).all()
    assert np.isnan(pair_correlations(df.limit(1), ["b", "flat"])).all()
    assert pair_correlations(df, []).shape == (0, 0)
    nan = df.withColumn("b", F.when(F.rand(1) < 0.1, F.lit(float("nan"))).otherwise(F.col("b")))
    assert np.isnan(pair_correlations(nan, ["b", "c d"])[0, 1])
    assert np.isnan(pair_correlations(df.select("a", F.lit(None).cast("double").alias("none")), ["a", "none"])[0, 1])


def test_vif_is_the_variance_left_by_the_other_columns(spark):
    pdf = frame().dropna()[["a", "b", "e.f"]].rename(columns={"e.f": "e"})
    got = dict(vif(as_nulls(spark, pdf), ["a", "b", "e"]))
    for c in pdf:
        others = np.column_stack([np.ones(len(pdf)), pdf.drop(columns=c)])
        rest = pdf[c] - others @ np.linalg.lstsq(others, pdf[c], rcond=None)[0]
        assert got[c] == pytest.approx(((pdf[c] - pdf[c].mean()) ** 2).sum() / (rest ** 2).sum(), rel=1e-6)


def test_complementary_error_function(spark):
    zs = [0.0, 1e-8, 0.3, 1.0, 1.999, 2.0, 2.5, 5.0, 9.0, 26.0]
    for r in spark.createDataFrame([(z,) for z in zs], "z double").select("z", erfc(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(math.erfc(r.z), rel=1e-11)


def by_integration(x, k):
    top = max(x, k) + 60 * math.sqrt(2 * k) + 200
    t = np.linspace(x, top, 400_001)
    density = np.exp((k / 2 - 1) * np.log(np.maximum(t, 1e-300)) - t / 2 - k / 2 * math.log(2) - math.lgamma(k / 2))
    h = t[1] - t[0]
    return h / 3 * (density[0] + density[-1] + 4 * density[1:-1:2].sum() + 2 * density[2:-1:2].sum())


def test_chi_square_tail(spark):
    cases = [(x, k) for k in (1, 2, 3, 4, 5, 8, 31, 60, 501, 2000) for x in (0.5 * k + 0.1, float(k), 1.4 * k + 3)] + [(1800.0, 3), (0.7, 7)]
    df = spark.createDataFrame(cases, "x double, k int")
    for r in df.select("x", "k", chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect():
        assert r.p == pytest.approx(by_integration(r.x, r.k), rel=1e-6, abs=1e-12)
    odd = spark.createDataFrame([(None, 3), (2.0, None), (0.0, 4), (-1.0, 5), (3.0, 0)], "x double, k int")
    assert [r.p for r in odd.coalesce(1).select(chi_square_tail(F.col("x"), F.col("k")).alias("p")).collect()] == [None, None, 1.0, 1.0, 1.0]
