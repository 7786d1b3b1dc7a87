"""Exact distributed quantiles and prefix sums against brute force, including hot values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from budgetlens.functions import quantiles as Q
from budgetlens.functions.quantiles import exact_quantiles, quantile_values
from budgetlens.functions.ranking import prefix_sums, row_numbers


def _frame(spark, n=3000, seed=0, hot=True):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n).round(2)
    if hot:
        v[: n // 3] = 0.5  # one value holds a third of all rows
    g = rng.integers(0, 4, size=n)
    return spark.createDataFrame(pd.DataFrame({"g": g.astype(int), "v": v, "w": rng.exponential(size=n)})), v, g


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_exact_quantiles_match_numpy(spark, accuracy):
    df, v, g = _frame(spark)
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.99, 1.0]
    got = {round(r["prob"], 12): r["q"] for r in exact_quantiles(df, ["v"], probs, accuracy=accuracy).collect()}
    for p in probs:
        assert got[round(p, 12)] == pytest.approx(float(np.quantile(v, p)), abs=1e-12)


def test_grouped_quantiles_match_pandas(spark):
    df, v, g = _frame(spark, hot=True)
    res = exact_quantiles(df, ["v", "w"], [0.25, 0.5, 0.75], ["g"]).toPandas()
    pdf = df.toPandas()
    for _, r in res.iterrows():
        exp = pdf.loc[pdf.g == r.g, r.column].quantile(r.prob)
        assert r.q == pytest.approx(exp, abs=1e-12)


@pytest.mark.parametrize("accuracy, most", [(10_000, 5), (20, 5)])
def test_quantiles_by_repeated_selection(spark, monkeypatch, accuracy, most):
    monkeypatch.setattr(Q, "MOST", most)  # brackets narrow until hardly a value is left
    df, v, g = _frame(spark)
    wide = df.select("g", "v", "w", F.when(F.col("v") > 2, F.lit(float("inf"))).when(F.col("v") < -2, F.lit(float("-inf"))).otherwise(F.col("v")).alias("ends"))
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.51, 0.999, 1.0]
    rounds = []
    narrow = Q._narrow
    monkeypatch.setattr(Q, "_narrow", lambda *a: rounds.append(1) or narrow(*a))
    pdf = wide.toPandas()
    for r in exact_quantiles(wide, ["v", "w", "ends"], probs, ["g"], accuracy=accuracy).collect():
        x = np.sort(pdf.loc[pdf.g == r.g, r.column].to_numpy())
        a, b = x[int(np.floor(r.prob * (len(x) - 1)))], x[int(np.ceil(r.prob * (len(x) - 1)))]
        want = a if a == b else a + (r.prob * (len(x) - 1) % 1) * (b - a)
        assert r.q == pytest.approx(want, abs=1e-9)
    assert 1 <= len(rounds) <= 14, rounds


def test_quantile_ignores_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,), (2.0,)], "x double")
    assert quantile_values(df, "x", [0.5]) == [2.0]


@pytest.mark.parametrize("buckets", [1, 14, None])
def test_prefix_sums_match_cumsum(spark, buckets):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"p": rng.integers(0, 3, 500), "s": rng.permutation(500).astype(float), "c": rng.integers(0, 5, 500)})
    pdf = pdf.drop_duplicates(["p", "s"])
    df = spark.createDataFrame(pdf)
    out = prefix_sums(df, ["s"], ["c"], part_cols=["p"], descending=True, buckets=buckets).toPandas()
    exp = pdf.sort_values(["p", "s"], ascending=[True, False]).assign(cum=lambda d: d.groupby("p").c.cumsum())
    m = out.merge(exp, on=["p", "s"])
    assert len(m) == len(pdf) and (m.cum_c == m.cum).all()


def test_row_numbers_bucketed(spark):
    df = spark.range(0, 1000).withColumn("k", F.col("id") * 7 % 1000)
    from budgetlens.functions import ranking

    out = ranking.prefix_sums(df.withColumn("one", F.lit(1)), ["k"], ["one"], buckets=20).toPandas()
    assert sorted(out.cum_one) == list(range(1, 1001))
    assert (out.sort_values("k").cum_one.values == np.arange(1, 1001)).all()
    rn = row_numbers(df, ["k"]).toPandas()
    assert (rn.sort_values("k").rn.values == np.arange(1, 1001)).all()


def test_row_numbers_over_a_string_key(spark):
    df = spark.range(0, 500).withColumn("k", F.concat(F.lit("key"), (F.col("id") * 7 % 500).cast("string")))
    rn = row_numbers(df, ["k"]).toPandas()
    assert (rn.sort_values("k").rn.values == np.arange(1, 501)).all()


def test_hot_value_is_one_window_row_a_bucket(spark):
    """A value that a third of all rows hold is aggregated first, so no window key holds more than a few of its rows."""
    df, v, _ = _frame(spark)
    agg = df.groupBy("v").agg(F.count(F.lit(1)).alias("c"))
    out = prefix_sums(agg, ["v"], ["c"], buckets=8).toPandas().sort_values("v")
    values, counts = np.unique(v, return_counts=True)
    assert (out.cum_c.values == np.cumsum(counts)).all() and len(out) == len(values)


def test_quantiles_without_groups_take_two_passes_and_fall_back_on_misleading_brackets(spark, monkeypatch):
    from budgetlens.functions import quantiles as Q

    rng = np.random.default_rng(12)
    cols = {"a": rng.normal(size=5000), "b": np.where(rng.random(5000) < 0.3, 7.0, rng.random(5000)), "c": np.where(rng.random(5000) < 0.1, np.inf, rng.integers(0, 9, 5000)), "d": np.zeros(5000)}
    rows = [[None if (i + j) % 11 == 0 else float("nan") if (i + j) % 13 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(zip(*cols.values()))]
    df = spark.createDataFrame([(*r, None) for r in rows], "a double, b double, c double, d double, e double").repartition(5)
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    rounds = []
    monkeypatch.setattr(Q, "_in_rounds", lambda *a, old=Q._in_rounds: rounds.append(1) or old(*a))
    fast = Q.quantile_map(df, [*cols, "e"], probs)
    assert not rounds and len(fast) == 4 * len(probs)
    monkeypatch.setattr(Q, "_sketched", lambda *a, old=Q._sketched: [(j, i, n, lo + 0.5, hi + 0.5) for j, i, n, lo, hi in old(*a)])
    assert Q.quantile_map(df, [*cols, "e"], probs) == fast and len(rounds) == 1
    for j, c in enumerate(cols):
        kept = np.array([r[j] for r in rows if r[j] is not None and r[j] == r[j]])
        assert fast[(c, 0.25)] == pytest.approx(np.quantile(kept, 0.25))
